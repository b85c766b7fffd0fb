from hanok.llm import urls
from hanok.llm.registry import llm_query
from hanok.llm.tables import table


@llm_query("op6_url_filter")
def op6_url_filter(spark, folder):
    return urls.judge(table(spark, folder, "pages"))
