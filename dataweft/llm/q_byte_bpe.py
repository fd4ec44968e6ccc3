"""Query of the byte-level codec. SQL cannot express the merges; tests compare with the reference library."""

import public_tokenizers

from dataweft.llm import byte_bpe
from dataweft.llm.common import table
from dataweft.llm.queries import query


@query("op2_byte_bpe")
def op2_byte_bpe(spark, sf_dir):
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
