"""Small fixed dimensions: topics, departments, curated agency peers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Topic -> agencies that belong to it and keywords that suggest it.
TOPICS = {
    "environment": {
        "agencies": ["EPA", "NOAA", "DOI", "COE", "CEQ"],
        "keywords": ["air", "water", "climate", "emission", "wildlife", "pollution"],
    },
    "health": {
        "agencies": ["FDA", "CDC", "CMS", "HHS", "AHRQ", "NIH"],
        "keywords": ["drug", "medicine", "health", "patient", "hospital", "vaccine"],
    },
    "finance": {
        "agencies": ["SEC", "CFPB", "OCC", "FDIC", "TREAS", "IRS", "FTC"],
        "keywords": ["banking", "credit", "tax", "financial", "stock", "audit"],
    },
    "transport": {
        "agencies": ["DOT", "FAA", "FHWA", "FRA", "NHTSA", "MARAD", "TSA"],
        "keywords": ["aviation", "vehicle", "highway", "rail", "bridge", "safety"],
    },
    "labor": {
        "agencies": ["DOL", "OSHA", "EBSA", "ETA", "MSHA", "VETS", "WHD"],
        "keywords": ["work", "employee", "wage", "safety", "union", "pension"],
    },
    "energy": {
        "agencies": ["DOE", "NRC", "FERC", "NNSA", "BOEM", "BSEE"],
        "keywords": ["nuclear", "grid", "energy", "oil", "gas", "renewable"],
    },
    "security": {
        "agencies": ["DHS", "CISA", "DOJ", "FBI", "ATF", "DEA"],
        "keywords": ["threat", "cyber", "defense", "police", "crime", "border"],
    },
}

UNGROUPED_DEPARTMENT = "Other agencies"

# Parent department -> agency codes, in display order.
DEPARTMENTS = {
    "Agriculture": [
        "USDA", "AMS", "APHIS", "ARS", "CCC", "CSREES", "ERS", "FAS", "FCIC", "FNS", "FPAC", "FS", "FSA",
        "FSIS", "GIPSA", "NAL", "NASS", "NIFA", "NRCS", "RBS", "RHS", "RMA", "RTB", "RUS", "USDAIG",
    ],
    "Commerce": ["DOC", "BIS", "EDA", "ESA", "ITA", "MBDA", "NIST", "NOAA", "NTIA", "PTO", "USBC"],
    "Defense": ["DOD", "USA", "USAF", "USN", "COE"],
    "Education": ["ED"],
    "Energy": ["DOE", "BPA", "EERE", "EIA", "NNSA", "OEPNU", "SWPA", "WAPA"],
    "Health & Human Services": [
        "HHS", "ACF", "ACL", "AHRQ", "AOA", "ATSDR", "CDC", "CMS", "FDA", "HHSIG", "HRSA", "IHS", "NIH",
        "SAMHSA",
    ],
    "Homeland Security": [
        "DHS", "CISA", "FEMA", "FLETC", "FIRSTNET", "ICEB", "TSA", "USCBP", "USCG", "USCIS",
    ],
    "Housing & Urban Development": ["HUD"],
    "Interior": [
        "DOI", "BIA", "BLM", "BOEM", "BOR", "BSEE", "FWS", "MMS", "NPS", "ONRR", "OSM", "USGS",
    ],
    "Justice": ["DOJ", "ATF", "ATR", "BOP", "DEA", "EOIR", "FBI", "OJJDP", "OJP", "USPC"],
    "Labor": ["DOL", "BLS", "EBSA", "ECAB", "ETA", "MSHA", "OFCCP", "OSHA", "VETS", "WHD"],
    "State": ["DOS", "AID"],
    "Transportation": [
        "DOT", "FAA", "FHWA", "FMCSA", "FRA", "FTA", "MARAD", "NHTSA", "PHMSA", "RITA", "SLSDC",
    ],
    "Treasury": [
        "TREAS", "BPD", "CDFI", "FINCEN", "FISCAL", "IRS", "OCC", "OFAC", "OTS", "TTB", "USMINT",
    ],
    "Veterans Affairs": ["VA"],
    "Environmental Protection Agency": ["EPA", "EAB"],
    "Executive Office of the President": [
        "OMB", "OSTP", "ONDCP", "ONCD", "IPEC", "CEQ", "USTR", "OFPP", "NSPC",
    ],
    "Independent agencies": [
        "SEC", "FCC", "FTC", "CFPB", "CPSC", "CSB", "EEOC", "EIB", "FMC", "FRTIB", "GSA", "NARA", "NASA",
        "NCUA", "NLRB", "NRC", "NSF", "NTSB", "OPM", "PBGC", "PCLOB", "SBA", "SSA", "NIGC", "ASC", "FFIEC",
    ],
}

# Agency -> curated peers, in display order.
CURATED_PEERS = {
    "EPA": ["DOE", "DOT", "USDA", "NOAA"],
    "FDA": ["HHS", "USDA", "EPA"],
    "FCC": ["FTC", "DOJ"],
    "DOT": ["EPA", "DOE", "DHS"],
    "SEC": ["CFTC", "FTC", "DOJ"],
    "USDA": ["EPA", "FDA", "DOI"],
    "DOE": ["EPA", "DOT", "NRC"],
    "HHS": ["FDA", "CMS", "CDC"],
    "DHS": ["DOJ", "DOD", "DOT"],
    "DOJ": ["DHS", "FTC", "SEC"],
    "DOD": ["DHS", "DOE", "VA"],
    "HUD": ["EPA", "DOT", "ED"],
    "ED": ["HHS", "HUD"],
    "NOAA": ["EPA", "USDA", "DOI"],
}


def department_dim(spark: SparkSession) -> DataFrame:
    """(agency_code, department, department_order): one row per mapped agency."""
    rows = [
        (code, department, position)
        for position, (department, codes) in enumerate(DEPARTMENTS.items())
        for code in codes
    ]
    return spark.createDataFrame(
        rows, "agency_code string, department string, department_order int"
    )


def curated_peer_dim(spark: SparkSession) -> DataFrame:
    """(agency_code, position, peer_code)."""
    rows = [(a, i, p) for a, peers in CURATED_PEERS.items() for i, p in enumerate(peers)]
    return spark.createDataFrame(rows, "agency_code string, position int, peer_code string")
