"""Corpus pipeline: quality rules, near-duplicate join, suffix-array dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.  The first four return the columns
of documents; the last returns the token ids.

All stages take a null text for an empty one and whole texts of any length; an empty table gives an empty one.
Columns whose names the operators use themselves pass through unchanged.
"""

from __future__ import annotations

from oodspark.llm._shared import stored
from oodspark.llm.bpe import encoded
from oodspark.llm.jaccard import one_of_each
from oodspark.llm.mixing import mix
from oodspark.llm.quality import ALL_STOPS, LEARNING, keep_good
from oodspark.llm.suffixes import shortened


def quality(spark, docs, sf_dir):
    """Documents that the weakly supervised rules reject go; the fit may learn that a rule errs on good documents.

    Null, empty and other texts of fewer than 20 words fail the base test, so they go here.  Repeated rows get one verdict
    and stay repeated; a posterior of just the threshold keeps.
    """
    return keep_good(docs, bounds=LEARNING, stops=ALL_STOPS)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of five-word Jaccard similarity of 0.8 or more stays, that of the smallest id.

    Texts without words are linked with nothing and stay.  Of rows equal in id and text one stays; of rows of one id with
    other texts in one group, that of the smallest hash of its text.  A null id stays only in a group of null ids.
    """
    return one_of_each(docs, gram=5, similar=80, of=100)


def repeated_bytes(spark, docs, sf_dir):
    """Strings of 100 bytes or more that also start earlier are cut from the texts.

    No row goes, and null texts stay null.  Null ids come first; rows of one id stand in order of the hash of their text.
    """
    return shortened(docs)


def mixture(spark, docs, sf_dir):
    """Documents are repeated or left out so that each source has its target number of words.

    The null source is one of its own and comes last.  Rows without words stay once.  Reruns give the same rows.
    """
    return mix(docs)


def tokens(spark, docs, sf_dir):
    """doc_id, n_tokens and ids of each text of the mix; a null or empty text has no ids, and repeated rows stay repeated."""
    import public_tokenizers

    return encoded(docs, public_tokenizers.path("word_bpe_49k.json"), output="ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_bytes", repeated_bytes), ("mixture", mixture), ("tokens", tokens)]
#: Suffix arrays and merges are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The result of the last stage, from all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, f"pipeline-{name}")
    return docs
