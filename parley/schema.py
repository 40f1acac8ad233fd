"""Column layouts of the stored tables. Every table is keyed by ``archive_id``."""

from pyspark.sql import types as T

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_TS, _STRINGS = T.TimestampNTZType(), T.ArrayType(T.StringType())


def _struct(**fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# One parsed message of an export, before any enrichment.
RAW_MESSAGE = _struct(
    archive_id=_I, line_no=_L, ts=_TS, sender=_S, text=_S, msg_type=_S, attachment=_S
)

PARTICIPANT = _struct(
    archive_id=_I, participant_id=_S, display_name=_S, aliases=_STRINGS,
    is_phone_only=_B, message_count=_L,
)

MEDIA = _struct(
    archive_id=_I, media_id=_L, msg_id=_L, filename=_S, path=_S, kind=_S, ext=_S,
    size_bytes=_L, content_hash=_S, readable=_B, description=_S, transcript=_S,
    ocr_text=_S, detected_objects=_STRINGS, status=_S, error=_S, model_used=_S,
)

MESSAGE_TYPES = ("text", "media", "system", "deleted")
MEDIA_STATUSES = ("pending", "done", "skipped", "error")
