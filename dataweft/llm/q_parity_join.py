"""Query of the similarity join."""

from dataweft.llm import parity_join
from dataweft.llm.common import table
from dataweft.llm.queries import query


@query("op8_parity_join")
def op8_parity_join(spark, sf_dir):
    return parity_join.components(table(spark, sf_dir, "documents"))
