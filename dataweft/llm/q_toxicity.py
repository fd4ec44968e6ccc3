"""Query of the toxicity scores. SQL cannot express the fit; tests use brute-force neighbours and held-out accuracy."""

from dataweft.llm import toxicity
from dataweft.llm.common import crc_mod, table
from dataweft.llm.queries import query


def model(spark, sf_dir):
    return toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod(5) != 0)


@query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod(5) == 0).alias("held_out"))
    return toxicity.score(docs, model(spark, sf_dir), ["doc_id", "held_out"]).select("doc_id", "held_out", "score", "predicted")
