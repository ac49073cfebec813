import pytest


@pytest.fixture
def calls(spark):
    """Builds a table of transcripts from (call_id, text[, language[, source]]) tuples."""

    def build(rows):
        schema = "call_id bigint, text string, language string, source string"
        filled = [tuple(r) + (None,) * (4 - len(r)) for r in rows]
        return spark.createDataFrame(filled, schema)

    return build
