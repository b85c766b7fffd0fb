from hanok.llm import secrets
from hanok.llm.registry import llm_query
from hanok.llm.tables import table


@llm_query("op9_secret_scan")
def op9_secret_scan(spark, folder):
    return secrets.scan(table(spark, folder, "documents"))
