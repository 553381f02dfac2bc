"""Community dumps: one XML file of <row .../> elements a table, below a folder a site.

Archives must be unpacked first (extract() does it where the 7z program is
installed); the XML reader splits large files over tasks.  Attributes that are
absent are null, and '' becomes null here, once.
"""

from __future__ import annotations

import logging
import shutil
import subprocess
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Site
from ..functions.tags import parse_tags
from ..functions.values import text_or_null
from ..schema import COMMENT_ROWS, POST_ROWS

log = logging.getLogger(__name__)

_POSTS = {"Id": "id", "PostTypeId": "post_type", "ParentId": "parent_id", "AcceptedAnswerId": "accepted_answer_id", "Tags": "raw_tags", "Title": "title", "Body": "body", "Score": "score", "ViewCount": "view_count", "AnswerCount": "answer_count", "CreationDate": "creation_date", "LastActivityDate": "last_activity_date", "LastEditDate": "last_edit_date", "OwnerUserId": "owner_id"}
_COMMENTS = {"Id": "id", "PostId": "post_id", "UserId": "owner_id", "Score": "score", "Text": "text", "CreationDate": "creation_date"}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def member(spark: SparkSession, root: str, archive: str, name: str) -> str | None:
    """Path of a table of a site: in the unpacked folder named like the archive, with or without its ending."""
    for folder in (archive.removesuffix(".7z"), archive):
        path = f"{root.rstrip('/')}/{folder}/{name}"
        if exists(spark, path):
            return path
    return None


def extract(archive: str, into: str) -> bool:
    """Unpacks an archive on the driver with the 7z program; False where that is not installed."""
    program = shutil.which("7z") or shutil.which("7za")
    if program is None:
        log.warning("7z is not installed; unpack %s by hand", archive)
        return False
    subprocess.run([program, "x", "-y", f"-o{into}", archive], check=True, stdout=subprocess.DEVNULL)
    return True


def _rows(spark: SparkSession, path: str | None, schema: T.StructType, names: dict[str, str]) -> DataFrame:
    if path is None:
        df = spark.createDataFrame([], schema)
    else:
        df = spark.read.format("xml").option("rowTag", "row").schema(schema).load(path)
    return df.select(*[text_or_null(F.col(f"_{k}")).alias(v) for k, v in names.items()])


def read_posts(spark: SparkSession, root: str, sites: Iterable[Site]) -> DataFrame:
    """Posts of all sites with their alias as ``site`` and parsed ``tags``; a missing dump has no rows."""
    return _all(spark, root, sites, "Posts.xml", POST_ROWS, _POSTS).withColumn("tags", parse_tags(F.col("raw_tags")))


def read_comments(spark: SparkSession, root: str, sites: Iterable[Site]) -> DataFrame:
    return _all(spark, root, sites, "Comments.xml", COMMENT_ROWS, _COMMENTS)


def _all(spark, root, sites, name, schema, names) -> DataFrame:
    out = None
    for site in sites:
        path = member(spark, root, site.archive, name)
        if path is None:
            log.warning("%s of %s is missing", name, site.alias)
        rows = _rows(spark, path, schema, names).withColumn("site", F.lit(site.alias))
        out = rows if out is None else out.unionByName(rows)
    return out


def site_table(spark: SparkSession, sites: Iterable[Site]) -> DataFrame:
    """site, archive."""
    return spark.createDataFrame([(s.alias, s.archive) for s in sites], "site string, archive string")


def denied_tags(spark: SparkSession, sites: Iterable[Site]) -> DataFrame:
    """site, tag."""
    return spark.createDataFrame([(s.alias, t) for s in sites for t in s.denied_tags], "site string, tag string")


def questions(posts: DataFrame) -> DataFrame:
    """Questions that have tags."""
    return posts.where((F.col("post_type") == "1") & (F.size("tags") > 0))


def answers(posts: DataFrame) -> DataFrame:
    return posts.where(F.col("post_type") == "2")
