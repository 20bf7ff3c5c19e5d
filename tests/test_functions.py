"""Column functions on small cases with known answers."""

import pytest
from pyspark.sql import functions as F

from docketscope.functions import dates as D
from docketscope.functions import fields as X
from docketscope.functions import labels as L
from docketscope.functions import stance as ST
from docketscope.functions import text as TX


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("<p>Hello&nbsp;&amp; welcome</p>", "Hello & welcome"),
        ("a<br>b<br/>c", "a b c"),
        ("&amp;lt;", "<"),
        ("  many \n\t spaces ", "many spaces"),
        ("plain", "plain"),
        (None, None),
    ],
)
def test_display(one, raw, want):
    assert one(TX.text_display, raw) == want


def test_canonical(one):
    assert one(TX.text_canonical, "Section 508 — Really?!") == "section 508 really"


def test_contacts_and_skeleton(one):
    text = "Mail ME@x.org or see https://a.b/c and WWW.d.e, ZIP 20500."
    assert one(TX.text_skeleton, text) == "mail or see and zip"


def test_signed_variants_share_a_skeleton(one):
    build = lambda t, a, b: TX.text_skeleton(t, [a, b])
    first = one(build, "I am Jane Doe. Protect our rivers. Jane Doe, 20500", "Jane", "Doe")
    second = one(build, "I am Omar Khan. Protect our rivers. Omar Khan, 10001", "Omar", "Khan")
    assert first == second == "i am protect our rivers"


def test_short_names_are_kept(one):
    assert one(TX.text_strip_name, "we agree", "we") == "we agree"


def test_token_set(one):
    assert one(TX.text_token_set, "we go to the park") == "park the"
    assert one(TX.text_token_set, "park the park the") == "park the"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", True), ("See attached.", True), ("See attached file", True), ("See attached file(s).", True),
        ("see attached letter from the council", True),
        ("see attached comments, which describe our concerns in full", False),
        ("This is a full sentence about the rule.", False),
    ],
)
def test_placeholder(one, text, want):
    assert one(TX.is_placeholder, text) is want


def test_placeholder_body_ignores_markup(one):
    assert one(TX.is_placeholder_body, "<b>" + "&nbsp;" * 30 + "</b> see attached file") is True
    assert one(TX.is_placeholder_body, "Ham & eggs are served at the hearing today, twice") is False


def test_features(one):
    assert one(lambda d: TX.word_count(TX.text_canonical(d)), "One, two; three!") == 3
    assert one(TX.link_count, "see http://a.b and www.c.d, mail x@y.z") == 3
    assert one(TX.has_greeting, "Dear Secretary, …") is True
    assert one(TX.has_greeting, "Dearest friend") is False
    assert one(TX.has_signoff, "… Sincerely,") is True
    assert one(TX.has_signoff, "Sincerely yours") is False


def stance_of(one, text):
    build = lambda t: ST.stance_label(*ST.stance_hits(t))
    return one(build, text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("I strongly support this rule and urge you to adopt it", "support"),
        ("We strongly oppose and object to this", "oppose"),
        ("I support the goal but oppose this rule; I oppose it", "mixed"),
        ("The docket number is 12", "unclear"),
        ("I recommend a review", "unclear"),
        ("they are opposing this rule", "oppose"),
        (None, "unclear"),
    ],
)
def test_stance(one, text, want):
    assert stance_of(one, text) == want


def test_cue_next_to_accent_counts(one):
    # ASCII word boundary: an accented letter does not hide the cue
    assert one(lambda t: ST.phrase_hits(t, ["support"]), "ésupport") == 1
    assert one(lambda t: ST.phrase_hits(t, ["support"]), "xsupport") == 0


ODD_TEXTS = [
    None, "", " ", "a", " \t\x0b\f\r\n a\n\n b  c\u00a0d \u2028", "((x)) 1-2  (y) z!! ", "\u00e9t\u00e9 -- l'an\u0130 2024, a9 b", "www.a WWW.b http://c HTTPS://d xhttp://e",
    "a@b.c @ x@y", "Thanks", "no thanks, ", "THANK YOU\u2028", "regards . ", "thank  you", "Best regards,,\t,", "with withs withing xwith with_ dies dying died di this  is this\tis this is",
]


def test_forms_equal_the_plain_patterns(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(ODD_TEXTS)], "k int, t string")
    t = F.col("t")
    display = F.trim(F.regexp_replace(t, r"\s+", " "))
    words = F.size(F.filter(F.split(F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " ")), " "), lambda w: w != ""))
    pairs = {
        "display": (TX.text_display(t), display),
        "canonical": (TX.text_canonical(t), F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "))),
        "letters": (TX.text_letters(F.lower(t)), F.trim(F.regexp_replace(F.lower(t), "[^a-z]+", " "))),
        "words": (TX.word_count(TX.text_canonical(t)), words.cast("long")),
        "links": (TX.link_count(t), (F.regexp_count(t, F.lit(TX.URL_PATTERN)) + F.regexp_count(t, F.lit(TX.EMAIL_PATTERN))).cast("long")),
        "signoff": (TX.has_signoff(t), F.trim(t).rlike(rf"(?i){TX.WORD_START}(?:{'|'.join(TX.SIGNOFF_WORDS)}){TX.WORD_END}[\s,]*$")),
    }
    for phrase in ["with*", "die*", "this is", "b", "e*", "x y*", "a*"]:
        plain = F.regexp_count(t, F.lit(f"{TX.WORD_START}{ST.phrase_body(phrase)}{TX.WORD_END}"))
        pairs[phrase] = (ST.phrase_hits(t, [phrase]), F.coalesce(plain, F.lit(0)).cast("long"))
    bad = {n: F.collect_list(F.when(~a.eqNullSafe(b), F.col("k"))).alias(n) for n, (a, b) in pairs.items()}
    assert rows.agg(*bad.values()).first().asDict() == dict.fromkeys(pairs, [])


def test_cues_begin_with_a_letter_and_only_where_their_stem_occurs():
    # a look behind at every place of a text cost ten times as much
    for phrase in ST.SUPPORT_PHRASES + ST.OPPOSE_PHRASES:
        assert ST.cue_pattern(phrase).startswith(phrase[0] + TX.WORD_START[:-1])
        assert any(all(ST.cue_stem(phrase) in form for form in ST.word_forms(w)) for w in phrase.split(" "))
    assert ST.cue_stem("urge* the adoption") == "adoption" and ST.cue_stem("die*") == "di"


def test_overlapping_phrases_all_count(one):
    # "i support*", "support* this rule" and nothing else
    assert one(lambda t: ST.phrase_hits(t, ST.SUPPORT_PHRASES), "i support this rule") == 2


@pytest.mark.parametrize(
    ("amount", "want"),
    [
        ("84250000000.75", "$84.3B"), ("45600.00", "$45.6K"), ("999960", "$1M"), ("812", "$812"),
        ("0.0", "$0"), ("-7200", "-$7.2K"), ("2400000000000", "$2.4T"), ("unknown", None), (None, None),
    ],
)
def test_usd(one, amount, want):
    assert one(L.usd_compact, amount) == want


@pytest.mark.parametrize(("n", "want"), [(112, "112th"), (101, "101st"), (93, "93rd"), (2, "2nd"), (113, "113th"), (108, "108th")])
def test_ordinal(one, n, want):
    assert one(L.ordinal, n) == want


def test_labels(one):
    assert one(L.agenda_edition, "202310") == "Fall 2023"
    assert one(L.agenda_edition, "201904") == "Spring 2019"
    assert one(L.agenda_edition, "odd") == "odd"
    assert one(L.bill_label, "hr", "88") == "H.R. 88"
    assert one(L.congress_bill_url, "118", "HR", "88") == "https://www.congress.gov/bill/118th-congress/house-bill/88"
    assert one(L.congress_bill_url, "119", "zz", "1") is None
    assert one(L.cfr_citation, "21", "7", "7-3") == "21 CFR § 7.3"
    assert one(L.cfr_citation, "21", "7", None) == "21 CFR Part 7"
    assert one(L.cfr_citation, "21", None, None) == "Title 21 CFR"
    assert one(L.suit_nature, "110 Insurance: Marine") == "Insurance: Marine"
    assert one(L.gao_abstract, " What GAO Found\nMost plans lack dates.") == "Most plans lack dates."
    assert one(L.recipient_level, "p") == "Parent"
    assert one(L.filing_period, "first_quarter") == "Q1"
    assert one(L.date_label, "2025-02-09") == "Feb 9, 2025"
    assert one(L.date_label, "3000-01-01") is None
    assert one(L.month_label, "2025-02-09") == "Feb 2025"
    assert one(L.fec_committee_url, "D 7/9") == "https://www.fec.gov/data/committee/D%207%2F9/"


def test_deadlines(one):
    now = "2026-05-31"
    assert one(lambda e: D.days_until(e, now), "2026-06-02T12:00:00") == 3
    assert one(lambda e: D.deadline_state(e, now), "2026-06-02T12:00:00") == "red"
    assert one(lambda e: D.deadline_state(e, now), "2026-06-10") == "amber"
    assert one(lambda e: D.deadline_state(e, now), "2026-07-10") == "green"
    assert one(lambda e: D.deadline_state(e, now), "2026-05-01") == "closed"
    assert one(lambda e: D.deadline_state(e, now), "soon") is None
    assert one(lambda e: D.recently_closed(e, now), "2026-05-01") is True
    assert one(lambda e: D.recently_closed(e, now), "2026-04-01") is False
    assert one(lambda s, e: D.period_days(s, e), "2026-05-01", "2026-05-31") == 30
    assert one(lambda s, e: D.period_elapsed(s, e, "2026-05-16"), "2026-05-01", "2026-05-31") == 0.5
    assert one(lambda s, e: D.period_days(s, e), "2026-05-31", "2026-05-31") is None


def test_offsets_are_true_instants(one):
    stamp = lambda c: F.date_format(D.to_instant(c), "HH:mm:ss")
    assert one(stamp, "2026-05-31T15:03:53-04:00") == "19:03:53"


def test_eras(one):
    assert one(lambda d: D.era_of(D.to_day(d)), "2001-01-20") == "Bush II"
    assert one(lambda d: D.era_of(D.to_day(d), "party"), "2001-01-19") == "D"
    assert one(lambda d: D.era_of(D.to_day(d)), "1990-01-01") is None


def test_fields(one):
    assert one(X.unquote, '"quoted"') == "quoted"
    assert one(X.clean_text, '" "') is None
    raw = '{"data": {"attributes": {"title": "A"}, "title": "B"}, "title": "C"}'
    assert one(lambda r: X.raw_json_field(r, "title"), raw) == "A"
    assert one(lambda r: X.raw_json_field(r, "title"), '{"data": {"title": "B"}}') == "B"
    assert one(lambda r: X.raw_json_field(r, "title"), '{"title": "C"}') == "C"
    assert one(lambda r: X.raw_json_field(r, "title"), "broken") is None
    assert one(lambda o, f, n, t: X.comment_author(o, f, n, t), "", "Ann", "Lee", "T") == "Ann Lee"
    assert one(lambda o, f, n, t: X.comment_author(o, f, n, t), None, "", None, "") == "Anonymous"
    assert one(X.slug_list, "epa, doe,,epa") == ["epa", "doe"]
    assert one(lambda t, s, n: X.presidential_label(t, s, n), "Presidential Document", "Executive Order", "14000") == "Executive Order 14000"


def test_cue_words_have_their_forms():
    from docketscope.functions.stance import word_forms

    assert word_forms("oppose*") == ("oppose", "opposes", "opposed", "opposing")
    assert word_forms("adopt*") == ("adopt", "adopts", "adoptes", "adopted", "adopting")
    assert word_forms("favor") == ("favor",)
