"""Explicit schemas of the sources; nothing is inferred."""

from pyspark.sql import types as T

TURN_JSON = T.StructType(
    [
        T.StructField("speaker", T.StringType()),
        T.StructField("start", T.DoubleType()),
        T.StructField("end", T.DoubleType()),
        T.StructField("text", T.StringType()),
    ]
)
CONVERSATION_JSON = T.StructType([T.StructField("conversation", T.ArrayType(TURN_JSON))])

SEGMENT_JSON = T.StructType(
    [
        T.StructField("start", T.DoubleType()),
        T.StructField("end", T.DoubleType()),
        T.StructField("text", T.StringType()),
    ]
)
# exactly four keys; there is no confidence
TRANSCRIPT_JSON = T.StructType(
    [
        T.StructField("call_id", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("segments", T.ArrayType(SEGMENT_JSON)),
    ]
)

MANIFEST_JSON = T.StructType(
    [
        T.StructField("call_id", T.StringType()),
        T.StructField("audio_path", T.StringType()),
        T.StructField("reference_transcript", T.StringType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("sample_rate", T.IntegerType()),
    ]
)
