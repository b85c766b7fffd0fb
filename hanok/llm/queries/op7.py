from hanok.llm import simhash
from hanok.llm.registry import llm_query
from hanok.llm.tables import table


@llm_query("op7_simhash")
def op7_simhash(spark, folder):
    return simhash.near_groups(table(spark, folder, "documents"))
