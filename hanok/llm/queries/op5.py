from hanok.llm import maxent
from hanok.llm.registry import llm_query
from hanok.llm.tables import table


@llm_query("op5_lm_score")
def op5_lm_score(spark, folder):
    return maxent.score(table(spark, folder, "documents"))
