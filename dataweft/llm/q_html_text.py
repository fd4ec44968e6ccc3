"""Query of the page texts. SQL cannot read markup; tests compare with small pages of known text."""

from dataweft.llm import html_text
from dataweft.llm.common import table
from dataweft.llm.queries import query


@query("op6_html_text")
def op6_html_text(spark, sf_dir):
    return html_text.main_text(table(spark, sf_dir, "pages"))
