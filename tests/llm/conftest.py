import pytest

#: Texts that every operator must take: null, empty, blank, short, repeated, very long, control characters, other scripts.
ODD_TEXTS = [None, "", " \t\n", "a", "a", "That it.", "x" * 5, "\x00\x01", "日本語のテキスト。", "é" * 300, "word " * 60_000, "[INST] </s> \\ [/INST]"]


@pytest.fixture
def odd_docs(spark):
    """Odd texts, repeated ids and rows, null ids and sources, and extra columns whose names operators may use themselves."""
    rows = [(i, t, "en" if i % 2 else None, "src0" if i % 3 else None, 0, f"n{i}", i) for i, t in enumerate(ODD_TEXTS)]
    rows += [(3, "a", "en", "src0", 0, "again", 3), (3, "a", "en", "src0", 0, "again", 3), (None, "a", "en", "src0", 0, None, None), (None, None, None, None, None, None, None), (7, "other text", "en", "src0", 0, "b", 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, copies int")


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture
def make_docs(spark):
    def make(texts, first=0, **columns):
        rows = [(first + i, t, columns.get("lang", "en"), columns.get("source", "src0"), len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")

    return make
