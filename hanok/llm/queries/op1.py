from hanok.llm import language
from hanok.llm.registry import llm_query
from hanok.llm.tables import table


@llm_query("op1_language_id")
def op1_language_id(spark, folder):
    return language.of_documents(table(spark, folder, "documents"))


@llm_query("language_of_pages")
def language_of_pages(spark, folder):
    return language.of_pages(table(spark, folder, "pages"))
