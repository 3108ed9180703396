"""The filter language: tokens, trees, and rows chosen against DuckDB."""

import random

import duckdb
import pytest

from siftline.functions.names import ColumnMap, resolve, sanitize
from siftline.functions.text import format_size, is_iso_date, literal_number
from siftline.plans.filters import And, Not, Or, Term, compile_filter, parse, search_words, tokenize


def kinds(text):
    return [t.kind for t in tokenize(text)]


def test_tokens():
    assert kinds("remote:true city:London") == ["TERM", "AND", "TERM"]
    assert len(tokenize("(city:London OR city:Paris) AND remote:true")) == 7
    assert [t.text for t in tokenize('company:"x y" "a b"c') if t.text] == ['company:"x y"', '"a b"', "c"]
    assert kinds("a not b && c || (d)") == ["TERM", "AND", "NOT", "TERM", "AND", "TERM", "OR", "(", "TERM", ")"]


def test_trees():
    a, b, c = map(Term, "abc")
    assert parse(tokenize("a OR b AND c")) == Or((a, And((b, c))))
    assert parse(tokenize("NOT a b")) == And((Not(a), b))
    assert parse(tokenize("(a b")) == And((a, b))
    assert parse(tokenize("a ) b")) == And((a, b))
    assert parse(tokenize("OR a")) is None
    assert parse([]) is None


def test_search_words():
    assert search_words(' a "b c"  d"e f"g "" "open end') == ["a", "b c", "de fg", "open end"] and search_words("") == []


def test_literals():
    for text, value in (("80000", 80000), ("$80,000", 80000), ("80k", 80000), ("120.5k", 120500), ("1.5m", 1500000), ("inf", None), ("", None), ("x", None)):
        assert literal_number(text) == value
    assert is_iso_date(" 2026-01-31 ") and not is_iso_date("2026-1-31")
    assert [format_size(n) for n in (3 << 30, 5 << 20, 2048, 7)] == ["3.00 GB", "5.0 MB", "2 KB", "7 B"]


def test_names():
    assert [sanitize(n) for n in ("a.b", "a_b", "1st", "", "Prénom", "A-B")] == ["a_b", "a_b", "col_1st", "col", "prénom", "a_b"]
    assert ColumnMap.of(["a.b", "a_b"]).originals == {"a_b": ("a.b",)}
    assert ColumnMap.of(["a.b", "a_b"], "coalesce").originals == {"a_b": ("a.b", "a_b")}
    assert resolve("REMOTE", ["job_remote"]) == "job_remote"
    assert resolve("company", ["x", "source_name"]) == "source_name"
    assert resolve("company", ["first_name"]) == "first_name"
    assert resolve("nosuch", ["a"]) is None


ROWS = [
    ("CVS Health", "London", "true", "80000", "2026-01-05"), ("Balfour", " Paris ", "false", "$95,500", "2026/02/01"), (None, "  ", "1", "50k", "2026-03-01 10:00:00"),
    ("a_b%c", " ", "yes", "-50", "junk"), ("it's \\ here", None, "No", "", None), ("cvs health ", "Londonderry", None, None, "2025-12-31"), ("Äpfel", "true", "0", "1.2.3", "2026-13-01"),
]
COLUMNS = ("source_name", "city", "remote", "salary", "date")
N = "TRY_CAST(REGEXP_REPLACE(salary, '[^0-9.]', '', 'g') AS DOUBLE)"
CASES = {
    "": "true",
    "OR city:x": "true",
    "city:london": "city ILIKE '%london%'",
    'company:"CVS Health"': "LOWER(TRIM(source_name)) = 'cvs health'",
    "company:CVS -city:london": "source_name ILIKE '%CVS%' AND NOT (city ILIKE '%london%')",
    "city!=london": "(city IS NULL OR NOT city ILIKE '%london%')",
    "!city:london": "NOT (city ILIKE '%london%')",
    "missing:city": "(city IS NULL OR TRIM(city) = '')",
    "is:valid:city": "(city IS NOT NULL AND TRIM(city) <> '')",
    "salary:>80k": f"{N} > 80000",
    "salary<=95,500": f"{N} <= 95500",
    "salary:50..100k": f"{N} BETWEEN 50 AND 100000",
    "date:>=2026-02-01": "TRY_CAST(replace(date, '/', '-') AS DATE) >= DATE '2026-02-01'",
    "date:2026-01-01..2026-02-28": "TRY_CAST(replace(date, '/', '-') AS DATE) BETWEEN DATE '2026-01-01' AND DATE '2026-02-28'",
    "remote:true": "(LOWER(TRIM(remote)) IN ('true', '1', 'yes') OR remote ILIKE '%true%')",
    "remote:no": "(remote IS NULL OR LOWER(TRIM(remote)) IN ('false', '0', 'no', '') OR remote ILIKE '%false%')",
    "remote!=yes": "(remote IS NULL OR LOWER(TRIM(remote)) NOT IN ('true', '1', 'yes'))",
    "company:a_b%c": "source_name ILIKE '%a_b%c%'",
    "company:\\": "contains(source_name, '\\')",
    "company:it's": "contains(source_name, 'it''s')",
    "missing:nosuch": "false",
    "city:>Lz": "city > 'Lz'",
    "(city:Austin OR city:Paris) remote:false": "(city ILIKE '%Austin%' OR city ILIKE '%Paris%') AND (remote IS NULL OR LOWER(TRIM(remote)) IN ('false','0','no','') OR remote ILIKE '%false%')",
    "health": " OR ".join(f"{c} ILIKE '%health%'" for c in COLUMNS),
}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(str(i), *r) for i, r in enumerate(ROWS)], "row string, " + ", ".join(f"{c} string" for c in COLUMNS)).cache()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, " + ", ".join(f"{c} VARCHAR" for c in COLUMNS) + ")")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?)", [(i, *r) for i, r in enumerate(ROWS)])
    return con


def chosen(table, text):
    return sorted(int(r["row"]) for r in table.filter(compile_filter(text, COLUMNS)).select("row").collect())


def wanted(duck, condition):
    return [r[0] for r in duck.execute(f"SELECT i FROM t WHERE {condition} ORDER BY i").fetchall()]


@pytest.mark.parametrize("text", CASES)
def test_rows(table, duck, text):
    assert chosen(table, text) == wanted(duck, CASES[text])


def test_random_trees(table, duck):
    """Conditions put together at random choose what their SQL chooses."""
    rng = random.Random(4)
    plain = [k for k in CASES if k and not k.startswith("OR") and "(" not in k and " " not in k]

    def make(depth):
        if not depth or rng.random() < 0.3:
            k = rng.choice(plain)
            return k, f"({CASES[k]})"
        kind, (a, x), (b, y) = rng.choice(["AND", "OR", "NOT"]), make(depth - 1), make(depth - 1)
        return (f"NOT ({a})", f"(NOT {x})") if kind == "NOT" else (f"({a}) {kind} ({b})", f"({x} {kind} {y})")

    for _ in range(15):
        text, sql = make(3)
        assert chosen(table, text) == wanted(duck, sql), text
