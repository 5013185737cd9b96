"""Explicit schemas of the stored JSON documents and tables."""

from pyspark.sql import types as T

DETAIL = T.StructType(
    [
        T.StructField("scores", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("needs_review", T.BooleanType()),
        T.StructField("reason", T.StringType()),
        T.StructField("skew", T.DoubleType()),
        T.StructField("ink_ratio", T.DoubleType()),
        T.StructField("word_count", T.IntegerType()),
    ]
)

TEXT_LINE = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("conf", T.DoubleType()),
        T.StructField("rect", T.ArrayType(T.DoubleType())),
    ]
)

PAGE_RESULT = T.StructType(
    [
        T.StructField("angle", T.IntegerType()),
        T.StructField("method", T.StringType()),
        T.StructField("details", DETAIL),
        T.StructField("text", T.ArrayType(TEXT_LINE)),
    ]
)

PAGE_DETAIL = T.StructType(
    [*DETAIL.fields, T.StructField("angle", T.IntegerType()), T.StructField("method", T.StringType())]
)

FILE_SUMMARY = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("page_rotations", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("page_details", T.MapType(T.StringType(), PAGE_DETAIL)),
    ]
)

PAGE_KEYS = [
    T.StructField("job_id", T.LongType()),
    T.StructField("filename", T.StringType()),
    T.StructField("page", T.IntegerType()),
]

# What a page extractor returns, keyed like its input.
EXTRACTED = T.StructType(
    [
        *PAGE_KEYS,
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("ink_ratio", T.DoubleType()),
        T.StructField("meta_rotation", T.IntegerType()),
        T.StructField("error", T.StringType()),
        T.StructField(
            "lines",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("angle", T.IntegerType()),
                        T.StructField("ord", T.IntegerType()),
                        T.StructField(
                            "box",
                            T.ArrayType(
                                T.StructType(
                                    [T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]
                                )
                            ),
                        ),
                        T.StructField("text", T.StringType()),
                        T.StructField("conf", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)
