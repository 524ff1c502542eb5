import random

from hypothesis import given, settings
from hypothesis import strategies as st

from wayfold.operators import packed

BARE = "abz019._-"


def read(field):
    return packed.best_parse(field, {}, 20.0)


def test_examples():
    assert read("[1, 2]") == [(1, "1"), (2, "2")]
    assert read("[[/  / '45']]") == [(3, "45")]
    assert read("<'876' / 'St Ulla''s Row; km 0,8' / \"a, b\">") == [(1, "876"), (2, "St Ulla's Row; km 0,8"), (3, "a, b")]
    assert read('["a ""b"" c", "x\\"y"; ]') == [(1, 'a "b" c'), (2, 'x"y')]
    assert read("['it\\'s new','b']") == [(1, "it's new"), (2, "b")]
    assert read('"40.0"//"26.0"') == [(1, "40.0"), (3, "26.0")]
    assert read("{1128 · }") == [(1, "1128")]
    assert read(" ,a\t\n b、c ") == [(2, "a"), (3, "b"), (4, "c")]
    assert read("('', 5)") == [(2, "5")]
    for hollow in ("", "   ", "[]", "[[ ]]", "()", "<\t>"):
        assert read(hollow) == []


def test_open_quote_falls_back_to_another_dialect():
    assert read("5' 6") == [(1, "5"), (2, "6")] or read("5' 6")[0] == (1, "5")
    assert read('12" | 14" | "a, b"')[-1][1] == "a, b"


value = st.one_of(st.text(BARE, min_size=1, max_size=5).map(lambda v: ("bare", v)), st.text("ab ,;|'\"[]()/", min_size=1, max_size=8).map(lambda v: ("quoted", v)), st.just(("gap", "")))


@settings(max_examples=200, deadline=None)
@given(st.lists(value, min_size=1, max_size=8), st.sampled_from("'\""), st.sampled_from([",", ";", "|", "/", "·", "、"]), st.sampled_from(["", " ", "\t", "\n "]), st.sampled_from(["", "[]", "()", "{}", "<>"]), st.booleans())
def test_round_trip(items, quote, mark, blank, bracket, doubled):
    """What a writer packs comes out again: values, positions, gaps."""
    out, want = [], []
    for pos, (kind, v) in enumerate(items, 1):
        if kind == "quoted":
            # a backslash just before a quote would be read with it
            esc = quote * 2 if doubled else "\\" + quote
            out.append(quote + v.replace(quote, esc) + quote)
        else:
            out.append(v)
        if v.strip():
            want.append((pos, v.strip()))
    field = (blank + mark + blank).join(out)
    if len(items) == 1 and items[0][0] == "gap":
        want = []
    if bracket:
        field = bracket[0] + field + bracket[1]
    assert packed.parse(packed.strip_list(field), "'\"")[0] == want


def test_frame(spark):
    rows = [(1, "[1, 2]", "x"), (1, "[1, 2]", "y"), (2, None, "x"), (3, "", "x"), (4, "'a b';c;;d", "x"), (None, "[7]", "x")]
    df = spark.createDataFrame(rows, "rec_id long, f string, pos string")
    got = sorted((r["rec_id"] or 0, r["pos"], r["value"]) for r in packed.split_packed(df, "rec_id", "f").collect())
    assert got == [(0, 1, "7"), (1, 1, "1"), (1, 2, "2"), (4, 1, "a b"), (4, 2, "c"), (4, 4, "d")]
    assert packed.split_packed(df.limit(0), "rec_id", "f").collect() == []


def test_very_long_field(spark):
    random.seed(1)
    vals = [str(random.randrange(10**6)) for _ in range(200_000)]
    df = spark.createDataFrame([(1, "[" + ", ".join(vals) + "]"), (2, "'" + "x" * 2_000_000 + "'")], "rec_id long, f string")
    out = packed.split_packed(df, "rec_id", "f")
    assert out.filter("rec_id = 1").count() == len(vals)
    assert out.filter("rec_id = 2 and length(value) = 2000000 and pos = 1").count() == 1


def test_code_lengths_cover_all_fields(spark):
    df = spark.createDataFrame([(i, "['a b', 12]") for i in range(30)] + [(99, "x_1")], "rec_id long, f string")
    code, escape = packed.value_codes(df, "f")
    assert code["a "] < code["a_"] <= escape and code["0$"] < escape and "$0" not in code


def test_balanced_quotes_never_lose():
    """Whatever the value's length and kind, and whether the column knows its like or not."""
    words = " ".join(f"w{i}," for i in range(60)) + " end"
    for code in ({}, {"^a": 0.1, "a$": 0.1, "aa": 0.1}):
        for q in "'\"`":
            for v in ("the quick brown fox jumps over the lazy dog", words, "; ; ;", "x" * 5000, "a\tb / c | d", "[was 'x']".replace("'", "") if q == "'" else "[was far]"):
                assert packed.best_parse(f"[{q}{v}{q}, b; 7]", code, 20.0) == [(1, v), (2, "b"), (3, "7")]


def test_three_kinds_of_quotes_and_a_stray_one():
    assert read("""“it's”, "a, b"; 5' tall""") == [(1, "it's"), (2, "a, b"), (3, "5"), (4, "tall")]
    assert read("""'The "Ropewalk" link', "don't", `a "b' c`""") == [(1, 'The "Ropewalk" link'), (2, "don't"), (3, "a \"b' c")]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("'\"`"), st.text("ab ,;|()/'\"`", min_size=1, max_size=12)), min_size=1, max_size=5), st.sampled_from([", ", ";", " | ", " "]))
def test_mixed_quotes_round_trip(items, mark):
    """Each value in quotes of its own, other marks inside: no kind of mark is open at the end, so it comes out whole."""
    field = mark.join(q + v.replace(q, q * 2) + q for q, v in items)
    parsed = packed.parse(packed.strip_list(field), "\"'`")
    if parsed[3] + parsed[4] == 0:
        assert sum(packed.parse_cost(packed.parse(packed.strip_list(field), d), {}, 20.0)[0] == 0 for d in packed.dialects(field)) >= 1
        assert read(field) in [packed.parse(packed.strip_list(field), d)[0] for d in packed.dialects(field) if packed.parse_cost(packed.parse(packed.strip_list(field), d), {}, 20.0)[0] == 0]
