"""Schemas of the stages, and the check that a frame has what an operator needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType())}


def _fields(text: str) -> T.StructType:
    """``name type, name type``; no session is needed, unlike for DDL."""
    pairs = [f.split() for f in text.replace("\n", " ").split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


#: Attributes of the dumps, all text; an absent attribute is null.
POST_ROWS = T.StructType([T.StructField(f"_{n}", T.StringType()) for n in ("Id", "PostTypeId", "ParentId", "AcceptedAnswerId", "Tags", "Title", "Body", "Score", "ViewCount", "AnswerCount", "CreationDate", "LastActivityDate", "LastEditDate", "OwnerUserId")])
COMMENT_ROWS = T.StructType([T.StructField(f"_{n}", T.StringType()) for n in ("Id", "PostId", "UserId", "Score", "Text", "CreationDate")])

COARSE_QUESTIONS = _fields("site string, tags string, question_id string")
TAG_METRICS = _fields("site string, tag string, b bigint, a bigint, h1 double, h2 double")
THREAD_POSTS = _fields(
    """site_alias string, tags strings, question_id string, accepted_answer_id string, answer_count bigint, creation_date timestamp,
    last_activity_date timestamp, last_edit_date timestamp, owner_id string, score bigint, view_count bigint, comment_count bigint, title string,
    body string, site string, id string, type string"""
)
TOPIC_NAMES = T.StructType([T.StructField("topics", T.ArrayType(_fields("topic_index bigint, topic_name string, justification string, topic_id bigint, inferred_name string, rationale string")))])
VALIDATION_SHEET = _fields(
    """id string, site string, topic string, subtopics string, link string, topic_validation_1 string, topic_validation_2 string, topic_veredict string,
    subtopic_validation_1 string, subtopic_validation_2 string, subtopic_veredict string, technologies string"""
)

_LIKE = {"number": (T.NumericType,), "text": (T.StringType,), "time": (T.TimestampType, T.TimestampNTZType, T.DateType), "flag": (T.BooleanType,), "array": (T.ArrayType,)}


def require(df: DataFrame, *columns: str, **kinds: str) -> DataFrame:
    """Raises ValueError unless ``df`` has the columns; keywords also say what kind each is."""
    have = {f.name: f.dataType for f in df.schema}
    missing = [c for c in (*columns, *kinds) if c not in have]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    wrong = [f"{c} is {have[c].simpleString()}, not a {k}" for c, k in kinds.items() if not isinstance(have[c], _LIKE[k])]
    if wrong:
        raise ValueError("; ".join(wrong))
    return df
