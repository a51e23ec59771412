"""Readable text of odd pages against the operator's SQL, and entities against replacing one after the other."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from oodspark.llm import warc

#: Letters beyond ASCII follow a space: after the name of a tag Java sees no end of a word there, and SQL does.
BITS = ["<p>", "</p>", "<br>", "<BR/>", "<script>x</Script >", "<!-- a\n-->", "<head>", "</head>", "<style>", "</style>", "<a <br> >", "&amp;", "&lt;", "&amp;lt;", "&", "&l", "t;", "&nbsp;", "&copy;", "&&gt;", "&mdash;", " ", "  ", "\n", "\t", "\r", "\r\n", "word", " ö", "\u2028", "<", "> ", "\n \n", "</li", "<header>", " 漢", "&quot;", "&#39;", ";"]


def pages():
    rng = random.Random(3)
    found = ["<p>a</p>\u2028", "a \u0085", " \n \u2029", "", None, "&", "&amp;amp;", "&lt;&amp;lt;", "a\t b \r\n c", "<head>x", "<!---->b<script>"]
    return found + ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 40))) for _ in range(400)]


def test_as_its_sql(spark, tmp_path):
    """A line or paragraph separator at the end of a page ends no line, so blanks before it stay."""
    html = pages()
    pq.write_table(pa.table({"page_id": list(range(len(html))), "url": ["http://a/"] * len(html), "html": html}), tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    want = con.sql(f"SELECT page_id, block FROM ({warc.ORACLES['op1_warc_derivatives']}) WHERE record_type = 'conversion' ORDER BY 1").fetchall()
    got = warc.op1_warc_derivatives(spark, str(tmp_path)).filter("record_type = 'conversion'").select("page_id", "block").orderBy("page_id").collect()
    assert [tuple(r) for r in got] == want


@pytest.mark.parametrize("more", ["", "&amp;" * 5000])
def test_entities(spark, more):
    html = [x if x is None else x + more for x in pages()[:60]]

    def plain(x):
        for entity, char in warc.ENTITIES:
            x = x and x.replace(entity, char)
        return x

    got = spark.createDataFrame(list(enumerate(html)), "i long, x string").select("i", warc.resolved(F.col("x")).alias("y")).orderBy("i").collect()
    assert [r["y"] for r in got] == [plain(x) for x in html]
