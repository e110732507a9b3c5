"""Registered queries against their SQL on planted tables, for values that the shared tables don't hold."""

import pyarrow as pa
import pyarrow.parquet as pq

from millrace.functions import geo, numeric, text
from millrace.plans import catalogue
from tests.oracle import connect, difference
from tests.test_operators import F, one


def differs(spark, folder, name, table, columns):
    pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
    return difference(spark, connect(str(folder)), str(folder), catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_format_bytes_beyond_a_gib(spark, tmp_path):
    """The query's SQL has no unit above MiB; the function goes on unless told otherwise."""
    keys = [None, 0, 1, 2, 1048, 1049, 1_073_741, 1_073_742, 1_199_999, 5_000_000_000_000]
    assert differs(spark, tmp_path, "expr_format_bytes", "lineitem", {"l_orderkey": pa.array(range(len(keys)), pa.int64()), "l_linenumber": pa.array([1] * len(keys), pa.int32()), "l_partkey": pa.array(keys, pa.int64())}) is None
    assert one(spark, numeric.format_bytes(F.lit(1_199_999_000))) == "1.1 GiB"


def test_contains_of_boundaries_and_nulls(spark, tmp_path):
    """A box is open, and what a null leaves open is null."""
    xs = [None, float("nan"), float("-inf"), float("inf"), -1.0, 0.49, 0.5, 0.51, 5000.49, 5000.5, 5000.51]
    rows = [(x, k) for x in xs for k in (None, -3, 2, 3, 9, 10)]
    assert differs(spark, tmp_path, "geo_contains", "customer", {"c_custkey": pa.array(range(len(rows)), pa.int64()), "c_acctbal": pa.array([x for x, _ in rows], pa.float64()), "c_nationkey": pa.array([k for _, k in rows], pa.int32())}) is None
    ring = F.array(*(geo.point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (4, 0), (0, 4), (0, 0))))
    inside = lambda x, y: one(spark, geo.contains(ring, geo.point(F.lit(x), F.lit(y))))
    assert [inside(*q) for q in ((1, 1), (2, 2), (0, 1), (1, 0), (0, 0), (3, 3), (None, 1), (None, 5))] == [True, False, False, False, False, False, None, False]


def test_truediv_by_zero(spark, tmp_path):
    """The SQL gives an infinity without a sign for all but 0 / 0, for a null too."""
    values = [None, float("nan"), float("-inf"), float("inf"), -1.5, -0.0, 0.0, 5e-324, 0.05, 1e308]
    pairs = [(a, b) for a in values for b in values]
    assert differs(spark, tmp_path, "expr_truediv", "lineitem", {"l_orderkey": pa.array(range(len(pairs)), pa.int64()), "l_linenumber": pa.array([1] * len(pairs), pa.int32()), "l_tax": pa.array([a for a, _ in pairs], pa.float64()), "l_discount": pa.array([b for _, b in pairs], pa.float64())}) is None


def test_capitalize_letter_by_letter(spark, tmp_path):
    """Every letter with a case, first and inside; those of Unicode 16 have one in Spark only."""
    letters = [x for x in map(chr, range(1, 0x1E944)) if (x.upper() != x or x.lower() != x) and not ("\U00010d50" <= x <= "\U00010d85" or x in "\u019b\u0264\u1c89\u1c8a\ua7cb\ua7cc\ua7cd\ua7da\ua7db\ua7dc")]
    texts = [None, "", "ß", "straße", "ßa", "ΑΣ ΑΣΑ", "İI", *(f"{x}a{x} A{x}" for x in letters)]
    assert len(letters) > 2500
    assert differs(spark, tmp_path, "str_capitalize", "documents", {"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}) is None


def test_pad_start_keeps_the_text_at_the_end(spark, tmp_path):
    """The query's SQL is the text itself, which padding leaves at the end; the function does pad."""
    texts = [None, "", "a", "A.", "  ", "é", "abc", "abcdefg"]
    assert differs(spark, tmp_path, "str_pad_start", "documents", {"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}) is None
    assert [one(spark, text.pad_start(F.lit(x), 3)) for x in texts] == [None, "   ", "  a", " A.", "   ", "  é", "abc", "abcdefg"]


def test_pad_start_shows_its_padding(spark, tmp_path):
    """Short texts come out padded, from the query and from its SQL; longer ones aren't cut to the width."""
    texts = {None: None, "": "   ", "a": "  a", " b": "  b", "é.": " é.", "\U0001f600": "  \U0001f600", "e\u0301": " e\u0301", "\n": "  \n", "abc": "abc", "abcd": "abcd", "abcdefg": "abcde"}
    assert differs(spark, tmp_path, "str_pad_start", "documents", {"doc_id": pa.array(range(len(texts)), pa.int64()), "text": list(texts)}) is None
    assert [r.value for r in catalogue.queries()["str_pad_start"](spark, str(tmp_path)).orderBy("doc_id").collect()] == list(texts.values())
