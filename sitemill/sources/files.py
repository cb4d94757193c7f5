"""Readers and writers of the corpus contract: JSON objects, arrays and lines, CSV sheets, ID-only exports, bundles."""

from __future__ import annotations

import hashlib
import io
import json
import shutil
import urllib.request
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import file_system

CONTEXT = "context_id string, citing_id string, refid string, raw string, masked_text string"
PAPER = "id string, title string, abstract string, authors array<string>"


def read_contexts(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """JSON lines of contexts, of the wanted ids (context_id) if given; masked_text becomes masked."""
    d = spark.read.schema(CONTEXT).json(path).where("context_id IS NOT NULL").withColumnRenamed("masked_text", "masked")
    return d if wanted is None else d.join(wanted.select("context_id").distinct(), "context_id", "left_semi")


def read_papers(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Papers of all wanted ids, absent fields empty; one that is missing is an error when it is read."""
    d = spark.read.schema(PAPER).json(path)
    d = wanted.select("id").distinct().join(d.withColumn("there", F.lit(True)), "id", "left")
    there = F.when(F.col("there"), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("no paper "), F.col("id"))))
    empty = F.array().cast("array<string>")
    return d.select(there.alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("abstract", F.lit("")).alias("abstract"), F.coalesce("authors", empty).alias("authors"))


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


class JsonObjectSource(DataSource):
    """Files that are one JSON object each, as (key, value), read in constant memory: a record at a time, a task for each file."""

    @classmethod
    def name(cls) -> str:
        return "json_object"

    def schema(self) -> str:
        return "key string, value string"

    def reader(self, schema):
        return _ObjectReader(self.options["path"], int(self.options.get("buffer", 1 << 22)))


class _Piece(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _ObjectReader(DataSourceReader):
    def __init__(self, path: str, buffer: int):
        self.path, self.buffer = path, buffer

    def partitions(self):
        from pyarrow.fs import FileSelector, FileType

        fs, at = _store(self.path)
        if fs.get_file_info(at).type == FileType.File:
            return [_Piece(self.path)]
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        found = [x.path for x in fs.get_file_info(FileSelector(at, recursive=True)) if x.type == FileType.File and not x.base_name.startswith(("_", "."))]
        return [_Piece(scheme + x) for x in sorted(found)]

    def read(self, partition):
        yield from object_items(partition.path, self.buffer)


def _store(path: str):
    """The store that a path or address names, and the path there."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path.removeprefix("file:"))


def object_items(path: str, buffer: int = 1 << 22):
    """(key, value as JSON) of a top-level object; an empty file has none, one that breaks off ends without an error."""
    decoder, text, at = json.JSONDecoder(), "", 0
    fs, place = _store(path)
    with io.TextIOWrapper(io.BufferedReader(fs.open_input_file(place)), encoding="utf-8") as f:
        opened = done = False
        while True:
            more = "" if done else f.read(buffer)
            done = done or not more
            text, at = text[at:] + more, 0
            while True:
                at = _skip(text, at, "{, \t\r\n" if not opened else ", \t\r\n")
                if at >= len(text) or text[at] == "}":
                    break
                opened = True
                try:
                    key, colon = decoder.raw_decode(text, at)
                    value = _skip(text, colon, ": \t\r\n")
                    found, end = decoder.raw_decode(text, value)
                    if end >= len(text) and not done:
                        break  # a number may go on
                except (ValueError, IndexError):
                    break
                yield key, json.dumps(found, ensure_ascii=False)
                at = end
            if done:
                return


def _skip(text: str, at: int, what: str) -> int:
    while at < len(text) and text[at] in what:
        at += 1
    return at


def write_text(lines: DataFrame, path: str) -> None:
    """A column of lines, in the order they have, as one file of that name, in any store that Spark writes to.

    Tasks write their parts; the driver's machine puts these together as a stream, a buffer at a time."""
    spark = lines.sparkSession
    lines.write.text(path + ".parts")
    fs, parts = file_system(spark, path + ".parts")
    found = sorted((x.getPath() for x in fs.listStatus(parts) if x.getPath().getName().startswith("part-")), key=lambda x: x.getName())
    _, at = file_system(spark, path)
    out = fs.create(at, False)
    try:
        for part in found:
            spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes((stream := fs.open(part)), out, 1 << 20, False)
            stream.close()
    finally:
        out.close()
    fs.delete(parts, True)
    if "LocalFileSystem" in fs.getClass().getName():
        # a local store keeps checksums of its own, by which a changed file couldn't even be read and told
        raw, beside = file_system(spark, path.rpartition("/")[0] + f"/.{path.rpartition('/')[2]}.crc")
        raw.getRawFileSystem().delete(beside, False)


def copied(spark: SparkSession, path: str, target: Path) -> None:
    """A file of any of Spark's stores as one of the driver's own disk."""
    fs, at = file_system(spark, path)
    fs.copyToLocalFile(False, at, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{target}"), True)


def digest(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _digests(spark: SparkSession, path: str) -> dict[str, tuple[str, int]]:
    """Digest and lines of each file of a folder, from where it is read: as a stream, a buffer at a time, as one may be larger than a task's memory."""
    jvm, (fs, folder) = spark.sparkContext._jvm, file_system(spark, path)
    found = {}
    for x in fs.listStatus(folder):
        name = x.getPath().getName()
        if not x.isFile() or name.startswith(("_", ".")):
            continue
        sha, stream = jvm.java.security.MessageDigest.getInstance("SHA-256"), fs.open(x.getPath())
        null = jvm.java.io.OutputStream.nullOutputStream()
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(jvm.java.security.DigestInputStream(stream, sha), null, 1 << 20, False)
        whole = not x.getLen()
        if x.getLen():
            stream.seek(x.getLen() - 1)
            whole = stream.read() == 10
        stream.close()
        lines = spark.read.option("lineSep", "\n").text(x.getPath().toString()).count() if x.getLen() else 0
        found[name] = bytes(sha.digest()).hex(), lines - (not whole)
    return found


def export(frames: dict[str, DataFrame], folder: str, config: dict) -> dict:
    """Each frame, ids and numbers only, as one JSON-lines file sorted by all its columns, with a manifest of counts and digests.

    Spark writes the files, so the folder may be in any of its stores; rows are sorted by ranges, so no task has a whole file."""
    spark = next(iter(frames.values())).sparkSession
    for name, df in frames.items():
        write_text(df.orderBy(*df.columns).select(F.to_json(F.struct(*df.columns))), f"{folder}/{name}.jsonl")
    found = _digests(spark, folder)
    manifest = {"schema": 1, "config": config, "counts": {n: found[f"{n}.jsonl"][1] for n in frames}, "files": {f"{n}.jsonl": found[f"{n}.jsonl"][0] for n in frames}}
    write_text(spark.range(1).select(F.lit(json.dumps(manifest, sort_keys=True))), f"{folder}/manifest.json")
    return manifest


def verify_export(spark: SparkSession, folder: str) -> list[str]:
    """What is wrong with an exported folder; nothing if all digests and counts agree."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest.json", wholetext=True).first()[0])
    found, wrong = _digests(spark, folder), []
    for name, want in manifest["files"].items():
        if name not in found:
            wrong.append(f"{name} is missing")
        elif found[name][0] != want:
            wrong.append(f"{name} has another digest")
        elif found[name][1] != manifest["counts"][name.removesuffix(".jsonl")]:
            wrong.append(f"{name} has another number of rows")
    return wrong


def bundle(source: str, target: str, allowed: list[str], forbidden: tuple[str, ...] = ("contexts.jsonl", "papers.jsonl")) -> dict:
    """Copies the allowed files, flat, into a new or empty folder with a manifest of bytes and digests."""
    src, dst = Path(source), Path(target)
    if dst.exists() and any(dst.iterdir()):
        raise ValueError(f"{target} isn't empty")
    if bad := [n for n in allowed if Path(n).name in forbidden]:
        raise ValueError(f"not for release: {', '.join(bad)}")
    if gone := [n for n in allowed if not (src / n).is_file()]:
        raise ValueError(f"missing: {', '.join(gone)}")
    dst.mkdir(parents=True, exist_ok=True)
    files = {}
    for n in allowed:
        shutil.copyfile(src / n, dst / Path(n).name)
        at = dst / Path(n).name
        files[at.name] = {"bytes": at.stat().st_size, "sha256": digest(at)}
    (dst / "MANIFEST.json").write_text(json.dumps({"files": files}, indent=1, sort_keys=True))
    return files


class _Redirects(urllib.request.HTTPRedirectHandler):
    """Follows a few redirects, and only to addresses that are as safe."""

    max_redirections, max_repeats = 5, 2

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        kind = newurl.split(":")[0].lower()
        if kind not in ("http", "https") or req.full_url.lower().startswith("https:") and kind != "https":
            raise ValueError(f"a redirect leads to {newurl!r}")
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def _opened(source: str, name: str, timeout: float):
    """A file of a bundle, from a folder, a file:// or an http(s):// address."""
    if source.startswith(("http://", "https://")):
        return urllib.request.build_opener(_Redirects).open(f"{source.rstrip('/')}/{name}", timeout=timeout)
    return (Path(source.removeprefix("file://")) / name).open("rb")


def fetch(source: str, target: str, limit: int = 1 << 32, manifest_limit: int = 1 << 20, timeout: float = 60.0) -> list[str]:
    """A bundle from a folder, or a file:// or http(s):// address: names are confined, sizes and redirects limited, digests checked, and all files move in at once or none."""
    dst = Path(target)
    with _opened(source, "MANIFEST.json", timeout) as f:
        data = f.read(manifest_limit + 1)
    if len(data) > manifest_limit:
        raise ValueError("the manifest is too large")
    listed = json.loads(data)["files"]
    for name, x in listed.items():
        if Path(name).name != name or name in ("", ".", ".."):
            raise ValueError(f"{name!r} leads out of the folder")
        if x["bytes"] > limit:
            raise ValueError(f"{name} is larger than {limit} bytes")
    stage = dst.with_name(dst.name + ".part")
    shutil.rmtree(stage, ignore_errors=True)
    stage.mkdir(parents=True)
    try:
        for name, x in listed.items():
            digest, n = hashlib.sha256(), 0
            with _opened(source, name, timeout) as a, (stage / name).open("wb") as b:
                while part := a.read(1 << 20):
                    n += len(part)
                    if n > x["bytes"]:
                        raise ValueError(f"{name} is longer than listed")
                    digest.update(part)
                    b.write(part)
            if digest.hexdigest() != x["sha256"]:
                raise ValueError(f"{name} has another digest")
        if dst.exists():
            raise ValueError(f"{target} exists")
        stage.rename(dst)
    finally:
        shutil.rmtree(stage, ignore_errors=True)
    return sorted(listed)
