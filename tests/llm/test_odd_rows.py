"""Every query on one table of odd rows: null ids, repeated rows, megabytes, clashing columns; and on an empty one."""

import pytest
from pyspark.sql import functions as F

from sigtok.llm import queries
from tests.llm.conftest import CLASHES, ODD

LONG = ("many words of one long text " * 40_000).strip()
ROWS = [*enumerate(ODD), (None, "one two"), (None, LONG), (50, LONG), (51, "one two"), (51, "one two"), (52, LONG + "\n" + "x" * 300_000)]
#: Columns that place a row among the others, and so differ between equal texts.
PLACES = {"doc_id", "start", "component_id", "kept", "sequence_id", "offset", "slot", "path", "from_dir", "effective_license", "cut_lines", "n_cut_lines", "text_md5", "class_id"}
DOCUMENT_QUERIES = sorted(q for q in queries.QUERIES if q != "op12_whitening")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("odd")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in ROWS]
    table = spark.createDataFrame(full, schema).repartition(3)
    for name in CLASHES:
        table = table.withColumn(name, F.col("n_chars") * 7)
    table.write.parquet(str(root / "odd" / "documents.parquet"))
    spark.createDataFrame([], schema).write.parquet(str(root / "none" / "documents.parquet"))
    return root


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_odd_rows(spark, folders, name):
    rows = [r.asDict() for r in queries.QUERIES[name](spark, str(folders / "odd")).collect()]
    by_row = [r for r in rows if r.get("piece", 0) == 0]
    assert sorted(r["doc_id"] is None for r in by_row) == sorted(i is None for i, _ in ROWS)
    assert sorted(r["doc_id"] for r in by_row if r["doc_id"] is not None) == sorted(i for i, _ in ROWS if i is not None)

    def what(i):
        """What a query says of the rows of an id, but for where they are."""
        keys = [k for k in rows[0] if k not in PLACES]
        return sorted({tuple((k, repr(r[k])) for k in keys) for r in rows if r["doc_id"] == i})

    assert what(6) == what(18) == what(51)
    assert set(what(None)) == {*what(51), *what(50)}


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_empty_table(spark, folders, name):
    none = queries.QUERIES[name](spark, str(folders / "none"))
    assert none.count() == 0
    assert none.dtypes == queries.QUERIES[name](spark, str(folders / "odd")).dtypes
