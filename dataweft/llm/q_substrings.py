"""Query of the substring deduplication."""

from dataweft.llm import substrings
from dataweft.llm.common import table
from dataweft.llm.queries import query


@query("op7_suffix_dedup")
def op7_suffix_dedup(spark, sf_dir):
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))
