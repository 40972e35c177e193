"""Routed output: records to sorted JSON, JSON Lines or plain lines, one file per route."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silkweb.functions.batches import small_batches
from silkweb.functions.content import parse_strict, stringify
from silkweb.operators.rules import route
from silkweb.sources.shared import shared_dir, written

#: Fields that stay within the store.
INTERNAL = ("hash", "crawled_at", "file", "seq")


def by_url() -> list[Column]:
    """The order of records in a file: as people sort names, ties by age."""
    return [F.collate("url", "UNICODE"), F.col("seq")]


def routed(records: DataFrame, output: dict, directory: str = "") -> DataFrame:
    """Records with the file they go to; those that no route takes are gone."""
    return records.withColumn("file", route(F.col("url"), output["routes"], output["exclude"], directory)).where("file IS NOT NULL")


@F.pandas_udf(T.StringType())
def _compact(urls, contents, datas, extras):
    import pandas as pd

    return pd.Series([_record(*row, None) for row in zip(urls, contents, datas, extras)])


@F.pandas_udf(T.StringType())
def _pretty(urls, contents, datas, extras):
    import pandas as pd

    return pd.Series(["  " + _record(*row, 2).replace("\n", "\n  ") for row in zip(urls, contents, datas, extras)])


def _record(url, content, data, extra, indent) -> str:
    """JSON of a record: url, content, data, then what transforms added."""
    members = {"url": url, "content": content}
    if data is not None:
        members["data"] = parse_strict(data)
    members |= {k: parse_strict(v) for k, v in (dict(extra) if extra is not None else {}).items()}
    return stringify(members, indent)


def rendered(records: DataFrame, form: str) -> DataFrame:
    """(file, line) pieces of the files, with url and seq to order them by. Unknown forms count as json."""
    small_batches(records.sparkSession)
    if form == "lines":
        line = F.concat_ws(" ", "url", F.coalesce("content", F.lit("")))
    else:
        line = (_compact if form == "jsonl" else _pretty)("url", "content", "data", "extra")
    return records.select("file", "url", "seq", line.alias("line"))


def files(records: DataFrame, form: str = "json") -> DataFrame:
    """(file, body, n): whole files, for those that fit a row each."""
    rows = rendered(records, form)
    part = F.array_sort(F.collect_list(F.struct(F.collate("url", "UNICODE").alias("k"), "seq", "line")))
    body = F.array_join(F.transform(part, lambda x: x["line"]), ",\n" if form not in ("lines", "jsonl") else "\n")
    whole = body if form == "lines" else F.concat(body, F.lit("\n")) if form == "jsonl" else F.concat(F.lit("[\n"), body, F.lit("\n]"))
    return rows.groupBy("file").agg(whole.alias("body"), F.count("*").alias("n"))


#: What stands before the first record, after each, and after the last one in place of that.
_FRAME = {"lines": ("", "\n", ""), "jsonl": ("", "\n", "\n"), "json": ("[\n", ",\n", "\n]")}
_EMPTY = {"lines": "", "jsonl": "\n", "json": "[]"}


def _write_files(records: DataFrame, form: str) -> dict[str, int]:
    """Write every file of ``records`` (with file); records per file."""
    return _write_pieces(rendered(records, form).withColumn("key", F.collate("url", "UNICODE")).drop("url"), form)


def _write_pieces(pieces: DataFrame, form: str) -> dict[str, int]:
    """Write every file of ``pieces`` (file, line, key, seq) in the order of key and seq; pieces per file.

    Executors sort and write parts of consecutive records, as many as there are partitions; the driver then copies the
    parts of a file one after the other, as bytes of which it holds a buffer. Files are few: the routes name them.
    """
    from silkweb.sources.store import delete, join_parts

    spark = pieces.sparkSession
    form = form if form in _FRAME else "json"
    first, between, last = _FRAME[form]
    rows = written(pieces.select("file", "line", "key", "seq"), "output-lines")
    counts = {r["file"]: r["n"] for r in rows.groupBy("file").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    number = F.create_map(*[F.lit(x) for k, f in enumerate(sorted(counts)) for x in (f, k)])
    parts = rows.withColumn("number", F.try_element_at(number, F.col("file")))
    place = f"{shared_dir(spark)}/silkweb/output-{uuid.uuid4().hex}"
    line = F.concat("line", F.lit(between[:-1])) if between != "\n" else F.col("line")
    parts.repartitionByRange("number", "key", "seq").sortWithinPartitions("number", "key", "seq").select("number", line.alias("line")).write.partitionBy("number").text(place)
    for k, path in enumerate(sorted(counts)):
        join_parts(spark, f"{place}/number={k}", path, first, len(between), last)
    delete(spark, place)
    return counts


def write_records(records: DataFrame, path: str, form: str = "json") -> int:
    """Write the records, whatever their route, into one file; their number."""
    from silkweb.sources.store import write_text

    n = _write_files(records.withColumn("file", F.lit(path)), form).get(path, 0)
    if not n:
        write_text(records.sparkSession, path, _EMPTY.get(form, "[]"))
    return n


@F.pandas_udf(T.StringType())
def _saved_record(urls, contents, times, datas, hashes, extras):
    import pandas as pd

    out = []
    for url, content, at, data, digest, extra in zip(urls, contents, times, datas, hashes, extras):
        members = {"url": url, "content": content, "crawledAt": at} | ({} if data is None else {"data": parse_strict(data)}) | {"hash": digest}
        members |= {k: parse_strict(v) for k, v in (dict(extra) if extra is not None else {}).items()}
        out.append("  " + stringify(members, 2).replace("\n", "\n  "))
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.StringType())
def _saved_entry(urls, files, statuses, errors, skips, referrers, depths):
    import pandas as pd

    names = ("url", "file", "status", "error", "skipped", "referrer", "depth")
    rows = zip(urls, files, statuses, errors, skips, referrers, depths)
    made = [{k: None if v is None or v != v else int(v) if k in ("status", "depth") else v for k, v in zip(names, row)} for row in rows]
    return pd.Series(["  " + stringify(m, 2).replace("\n", "\n  ") for m in made], dtype=object)


def save_json(queue: DataFrame, records: DataFrame, directory: str) -> dict[str, int]:
    """Write the queue and the records as pretty JSON, ``queue.json`` and ``records.json`` in the queue's order; rows of
    each. Executors print and write them in parts, as they do the routed files."""
    from silkweb.sources.store import write_text

    small_batches(queue.sparkSession)
    entry = _saved_entry("url", "file", F.col("status").cast("int"), "error", "skipped", "referrer", "depth")
    record = _saved_record("url", "content", "crawled_at", "data", "hash", "extra")
    counts = {}
    for name, frame, line in (("queue", queue, entry), ("records", records, record)):
        path = f"{directory}/{name}.json"
        counts[name] = _write_pieces(frame.select(F.lit(path).alias("file"), line.alias("line"), F.lit("").alias("key"), "seq"), "json").get(path, 0)
        if not counts[name]:
            write_text(frame.sparkSession, path, _EMPTY["json"])
    return counts


def format_records(records: DataFrame, output: dict, directory: str) -> dict[str, int]:
    """Write every routed file under ``directory`` and delete what else is there; records per file."""
    from silkweb.sources.store import prune

    counts = _write_files(routed(records, output, directory), output["format"])
    prune(records.sparkSession, directory, set(counts))
    return counts


def write_partitioned(records: DataFrame, output: dict, path: str) -> None:
    """Routed lines as text, a folder per file in parts of consecutive URLs, written by the executors."""
    rows = rendered(routed(records, output), "jsonl" if output["format"] == "json" else output["format"])
    rows = rows.repartitionByRange("file", F.collate("url", "UNICODE"), "seq").sortWithinPartitions("file", *by_url())
    rows.select("file", "line").write.partitionBy("file").mode("overwrite").text(path)

