import pytest
from pyspark.sql import functions as F

from textmill.functions import text as X
from textmill.functions.tokens import WORDS, n_windows, windows
from tests.helpers import one

T = F.col("t")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<p>Hallo <b>Welt</b></p> [url=http://example.com]Link[/url] [quote]Zitat[/quote]", "Hallo Welt Link Zitat"),
        ("&lt;b&gt;x&lt;/b&gt;", "<b>x</b>"),
        ("[b]Wichtige Frage[/b]", "Wichtige Frage"),
        (" a\t b \n\n\n c ", "a b \n c"),
        (None, ""),
        ("", ""),
    ],
)
def test_clean_markup(spark, text, want):
    assert one(spark, text, X.clean_markup(T)) == want


def test_signature(spark):
    assert one(spark, "Antwort\nMit freundlichen Grüssen\nX", X.remove_signature(T)) == "Antwort"
    assert one(spark, "A\n--  \nB\nC", X.remove_signature(T)) == "A"
    assert one(spark, "A\nbest REGARDS\nC", X.remove_signature(T)) == "A"
    assert one(spark, "A -- B", X.remove_signature(T)) == "A -- B"


def test_boilerplate(spark):
    text = "Einleitung\n42\nDies ist normaler Text.\nCopyright © 2024 X\nWeiterer normaler Text.\n© 2023 Y\nAbschluss"
    assert one(spark, text, X.remove_boilerplate(T)) == "Einleitung\nDies ist normaler Text.\nWeiterer normaler Text.\nAbschluss"
    assert one(spark, "Seite 3 von 9\r\nx", X.remove_boilerplate(T)) == "x"


@pytest.mark.parametrize(
    ("expr", "text", "want"),
    [
        (X.doc_id_of(T), "/a/Schulung Auftrag (2).pdf", "schulung_auftrag_2"),
        (X.doc_title(T), "A_B_C.pdf", "A B C"),
        (X.doc_title(T), "", ""),
        (X.stem(T), ".hidden", ".hidden"),
        (X.stem(T), "a.tar.gz", "a.tar"),
        (X.module_of(T), "schulungsunterlagen_auftrag_einsteiger", "Auftrag"),
        (X.module_of(T), "schulungsunterlagen_A_rest", ""),
        (X.module_of(T), "einwort", ""),
        (X.slug(T), "Wie lege ich einen neuen Kunden an?", "wie_lege_ich_einen_neuen_kunde"),
        (X.slug(T), "???", "query"),
        (X.normalize_page(T), "a  b\n\n\n\nc", "a b\n\nc"),
        (X.normalize_space(T), "a \t b\n\n\nc ", "a b\nc"),
        (X.terms(T), "Auftrag MWST Buchung 2024", ["auftrag", "mwst", "buchung", "2024"]),
        (X.first_words(T, 2), " a  b c", "a b"),
        (X.word_count(T), " a\tb\n c ", 3),
        (X.uninformative_subject(T), "Re: RE: ok", True),
        (X.uninformative_subject(T), "Re: Frage", False),
        (X.has_mojibake(T), "fÃ¼r", True),
        (X.has_caption(T), "siehe tabelle 3", True),
        (X.relative_path(T, "/root/x"), "/root/x/a\\b", "a/b"),
        (X.relative_path(T, "/root/x"), "/other/a", "/other/a"),
        (X.iso_date(T).cast("string"), " 2024-03-05T10:00", "2024-03-05"),
        (X.iso_date(T).cast("string"), "not-a-date", None),
        (X.iso_date(T).cast("string"), "2024-3-5", None),
        (X.iso_date(T).cast("string"), "2024-13-45", None),
        (X.iso_date(T).cast("string"), "", None),
        (X.signed_percent(T.cast("double")), "12.34", "+12.3%"),
        (X.signed_percent(T.cast("double")), "-1", "-1.0%"),
        (X.signed_percent(T.cast("double")), "0", "0.0%"),
        (X.signed_percent(T.cast("double")), None, None),
        (X.is_missing(T), "NaN", True),
        (X.is_missing(T), "x", True),
        (X.is_missing(T), "0.5", False),
        (X.epoch_date(T.cast("long")), "0", "1970-01-01"),
        (X.epoch_date(T.cast("long")), "1700000000", "2023-11-14"),
        (X.epoch_date(T.cast("long")), "999999999999999", ""),
        (X.aspect_ratio(T.cast("int"), F.lit(0)), "5", 5.0),
    ],
)
def test_scalars(spark, expr, text, want):
    assert one(spark, text, expr) == want


@pytest.mark.parametrize(
    ("chunk", "source", "want"),
    [
        ("forum__f1", "forum", "f1"),
        ("forum__f1_overflow_recursive_0001", "forum", "f1"),
        ("handbuch__h_x_h2_0003", "handbuch", "h_x"),
        ("handbuch__h_x_h3_0003_recursive_0007", "handbuch", "h_x"),
        ("handbuch__h_x_nooutline_recursive_0000", "handbuch", "h_x"),
        ("modulbeschreibung__m_page_0012", "modulbeschreibung", "m"),
        ("modulbeschreibung__m_page_0012_recursive_0013", "modulbeschreibung", "m"),
        ("ticket__x", "forum", ""),
    ],
)
def test_chunk_id(spark, chunk, source, want):
    assert one(spark, chunk, X.doc_id_of_chunk(T, F.lit(source))) == want


def test_keywords(spark):
    k = F.array(F.lit("a"), F.lit("ab"), F.lit("abc"), F.lit("x" * 61), F.lit(" ab "))
    assert one(spark, "", X.valid_keywords(k)) == ["ab", "abc", " ab "]
    assert one(spark, "", X.joined_keywords(F.array(F.lit(" a b "), F.lit("c")))) == "a b,c"


def test_windows(spark):
    for n, want in ((0, 0), (1, 1), (1000, 1), (1001, 2), (1850, 2), (1851, 3)):
        assert one(spark, "", n_windows(F.lit(n), 1000, 150)) == want
    parts = one(spark, " a b c  d e\n", windows(WORDS.split(T), 2, 1))
    assert parts == [" a b ", "b c  ", "c  d ", "d e\n"]
    assert one(spark, "  \n ", windows(WORDS.split(T), 2, 1)) == []
    assert one(spark, None, windows(WORDS.split(T), 2, 1)) == []
    text = "  x y\nz  "
    assert "".join(one(spark, text, WORDS.split(T))) == text


def test_byte_pair_tokens(spark, tmp_path):
    """Joined tokens give the text back, also where a character is cut."""
    import base64

    from pyspark.sql import functions as F

    from textmill.functions.tokens import tiktoken_tokenizer

    ranks = [bytes([b]) for b in range(256)] + [b"ab", b"abc"]
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(ranks)))
    tok = tiktoken_tokenizer(str(path), r"\S+|\s+")
    for t, n in (("abc ab ä€😀", 4 + 2 + 3 + 4), ("", 0)):
        r = spark.createDataFrame([(t,)], "t string").select(tok.split(F.col("t")).alias("x"), tok.count(F.col("t")).alias("n")).first()
        assert "".join(r["x"]) == t and r["n"] == n == len(r["x"])


def test_only_texts_with_references_reach_python(spark, monkeypatch):
    """Other texts stay in the JVM; nulls stay null."""
    seen = []
    monkeypatch.setattr(X, "_unescape", lambda c: seen.append(c) or F.upper(c))
    d = spark.createDataFrame([("a &amp; b",), ("plain",), (None,), ("",)], "t string")
    assert [r[0] for r in d.select(X.unescape(F.col("t"))).collect()] == ["A &AMP; B", "plain", None, ""]
    assert [r[0] for r in d.select(seen[0].isNull()).collect()] == [False, True, True, True]
