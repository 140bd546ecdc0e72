import pytest
from llm_texts import AWKWARD


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text) as a documents table whose extra columns carry awkward names."""
    def build(data, lang="en", source="s"):
        rows = [(r[0], r[1], r[2] if len(r) > 2 else lang, r[3] if len(r) > 3 else source, 1, "a", "b", 3, 4.5)
                for r in data]
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long, "
                  "n_words string, key string, size long, score double")
    return build


@pytest.fixture
def awkward(documents):
    """Awkward texts, some of them twice and some rows wholly repeated, with null ids, languages and sources."""
    data = [(k, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else "s") for k, t in enumerate(AWKWARD)]
    data += [(100 + k, t) for k, t in enumerate(AWKWARD)] + data[:5] + [(None, "no id at all"), (None, None)]
    return documents(data)
