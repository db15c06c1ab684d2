"""Reading document files and run manifests, and writing results."""

from __future__ import annotations

import hashlib
import json
import re
import subprocess
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``...-part;year`` anywhere in a file's name.
NAME = r"-(\d+);(\d{4})"


def part_year(filename: Column) -> tuple[Column, Column]:
    """Part and year in a file's name; null where it has none."""
    return F.regexp_extract(filename, NAME, 1).try_cast("int"), F.regexp_extract(filename, NAME, 2).try_cast("int")


def inventory(spark: SparkSession, folder: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """(filename, sha256, part, year, bytes) of the documents of a folder, by part and name. A name without part and year is an error, as
    is a folder without documents when the result is read by ``checked``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    part, year = part_year(F.url_decode(F.regexp_replace(name, r"\+", "%2B")))
    bad = F.raise_error(F.concat(F.lit("no part and year in "), name)).cast("int")
    return files.select(F.url_decode(name).alias("filename"), F.sha2("content", 256).alias("sha256"), F.when(part.isNotNull() & year.isNotNull(), part).otherwise(bad).alias("part"), year.alias("year"), F.col("length").alias("bytes")).orderBy("part", "filename")


def checked(df: DataFrame, what: str) -> DataFrame:
    """The rows, or an error if there are none."""
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


Backend = Callable[[bytes], list[str]]


def pdftotext(content: bytes) -> list[str]:
    """Pages of the text layer by the tool of that name, if it is installed."""
    done = subprocess.run(["pdftotext", "-enc", "UTF-8", "-", "-"], input=content, capture_output=True, check=True)
    pages = done.stdout.decode("utf-8", "replace").replace("\0", "").split("\f")
    while pages and not pages[-1].strip():
        pages.pop()
    return pages


def extract_pages(documents: DataFrame, text_layer: Backend = pdftotext, ocr: Backend | None = None, mode: str = "auto", least_chars: int = 120) -> DataFrame:
    """(filename, page_pdf, text, backend, reason) from (filename, content). ``mode`` is off, auto (pages of the text layer with fewer
    characters are read by ``ocr``) or force. A backend that fails gives no pages and the reason."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content in zip(batch["filename"], batch["content"]):
                try:
                    pages, why = text_layer(bytes(content)), "text_ok"
                except (OSError, subprocess.SubprocessError, ValueError) as e:
                    pages, why = [], f"text_failed: {type(e).__name__}"
                wanted = [mode == "force" or (mode == "auto" and len(re.sub(r"\s", "", p)) < least_chars) for p in pages]
                scanned = ocr(bytes(content)) if ocr and (any(wanted) or (mode != "off" and not pages)) else []
                for i in range(max(len(pages), len(scanned)) or 1):
                    use = i < len(scanned) and (i >= len(pages) or wanted[i])
                    text = scanned[i] if use else pages[i] if i < len(pages) else None
                    out.append((name, i + 1, text, "ocr" if use else "text_layer", ("forced" if mode == "force" else "low_text") if use else why))
            yield pd.DataFrame(out, columns=["filename", "page_pdf", "text", "backend", "reason"])

    return documents.select("filename", "content").mapInPandas(run, "filename string, page_pdf int, text string, backend string, reason string")


def manifests(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """JSON run manifests with the name of their file; fields that older files lack are null."""
    return spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("manifest", F.element_at(F.split(F.input_file_name(), "/"), -1))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` and those of ``old`` whose key isn't among them; columns that one of the two lacks are null there."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_documents(rows: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write rows in place of all rows of the same documents; the table is partitioned by document, other documents stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def stale_embeddings(payloads: DataFrame, stored: DataFrame, dimensions: int) -> DataFrame:
    """(chunk_id, reason) of (chunk_id, payload_hash) whose stored embedding (chunk_id, payload_hash, dims) is missing or of another text
    or size."""
    s = stored.select(F.col("chunk_id").alias("s_id"), F.col("payload_hash").alias("s_hash"), F.col("dims"))
    j = payloads.join(s, F.col("chunk_id") == F.col("s_id"), "left")
    reason = F.when(F.col("s_id").isNull(), "missing").when(F.col("payload_hash") != F.col("s_hash"), "changed").when(F.col("dims") != dimensions, "resized")
    return j.select("chunk_id", reason.alias("reason")).where("reason is not null")


def target_parts(command: str) -> list[int]:
    """The parts that a stored command line names, without repeats."""
    return sorted({int(n) for n in re.findall(r"--target-part(?:\s+|=)(\d+)", command)} | {int(n) for run in re.findall(r"--target-part((?:\s+\d+)+)", command) for n in run.split()})


def target_coverage(targets: DataFrame, found: DataFrame) -> DataFrame:
    """(target_id, problem): targets that are missing, found more than once, or not asked for."""
    n = found.groupBy("target_id").agg(F.count("*").alias("n"))
    j = targets.select("target_id").distinct().withColumn("asked", F.lit(True)).join(n, "target_id", "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("asked").isNull(), "unexpected").when(F.col("n") > 1, "duplicate")
    return j.select("target_id", problem.alias("problem")).where("problem is not null")


FORBIDDEN = frozenset({"text", "query_text", "heading", "snippet", "table_md", "table_csv", "content"})


def lockfile(path: str, value: dict) -> str:
    """Write metadata with a checksum over it; keys that would hold document text are refused at any depth. Gives the checksum."""

    def walk(x) -> None:
        if isinstance(x, dict):
            bad = FORBIDDEN & x.keys()
            if bad:
                raise ValueError(f"a lockfile must not hold {sorted(bad)}")
            for v in x.values():
                walk(v)
        elif isinstance(x, list):
            for v in x:
                walk(v)

    walk(value)
    checksum = hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    write_json(path, value | {"checksum": checksum})
    return checksum


def write_json(path: str, value) -> None:
    """Indented JSON with a line end, in a folder that is made if it isn't there."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, ensure_ascii=False, default=str) + "\n", encoding="utf-8")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
