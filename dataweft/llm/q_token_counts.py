"""Query of the token counts. SQL cannot express the merges; tests compare with the reference library."""

import public_tokenizers

from dataweft.llm import token_counts
from dataweft.llm.common import table
from dataweft.llm.queries import query


@query("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
