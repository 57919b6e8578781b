"""The row types that flow between the operators."""

from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

_S, _I, _L, _D = StringType(), IntegerType(), LongType(), DoubleType()


def _struct(**fields: DataType) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


OUTLINE = ArrayType(_struct(level=_I, title=_S, page=_I))
PAGES = ArrayType(_struct(page_number=_I, text=_S))
IMAGES = ArrayType(_struct(image_id=_S, page=_I, filepath=_S, width=_I, height=_I))
METADATA = _struct(
    post_id=_S, topic_id=_S, module=_S, post_date=_S, title=_S, ticket_id=_S, category=_S, version_reported=_S,
    version_resolved=_S, product=_S, status=_S, processed_date=_S, filename=_S, page_count=_I, image_count=_I,
)

#: A document of any source; (source_type, doc_id) is its key.
GOLD = _struct(doc_id=_S, source_type=_S, metadata=METADATA, content=_struct(full_text=_S, outline=OUTLINE, pages=PAGES), images=IMAGES)

QUESTION = _struct(id=_S, question=_S, category=_S, ground_truth=_S)

_HIT = _struct(id=_S, text=_S, metadata=_struct(source_type=_S, source_file=_S, chunk_index=_I), similarity=_D)
_RUN = _struct(variant=_S, model=_S, timestamp=_S, input_tokens=_L, output_tokens=_L, duration_seconds=_D)
#: One answered question; result is null where error is set.
BUNDLE = _struct(question_id=_S, category=_S, result=_struct(query=_S, answer=_S, retrieved_chunks=ArrayType(_HIT), metadata=_RUN), error=_S)

METRICS = ("faithfulness", "answer_relevance", "context_recall", "factual_correctness")
SCORES = _struct(question_id=_S, category=_S, **dict.fromkeys(METRICS, _D))

IMAGE_CACHE = _struct(image_id=_S, page=_I, width=_I, height=_I, vlm_description=_S)
