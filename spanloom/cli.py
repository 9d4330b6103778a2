"""Command line: ``python -m spanloom.cli -m extract|inject|clean [input [output]]`` over files or standard input.

``extract`` keeps its state in a folder and writes the block stream; ``inject``
reads a stream and writes documents; ``clean`` does both with the blocks as they
are. A stream's header names the folder and the document, so injection needs
neither, and a stream may hold many documents.
"""

from __future__ import annotations

import argparse
import base64
import contextlib
import os
import subprocess
import sys
import tempfile
from collections.abc import Callable, Iterator
from typing import BinaryIO

import xxhash
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .operators import detect
from .plans import engine
from .plans.engine import Settings
from .sources.tables import delete, exists, read_files
from .streaming import codec

VERSION = "0.2.0"
MODES = ("extract", "inject", "clean")
_TAGS = {"tags-prot": "prot", "tags-prot-inline": "prot_inline", "tags-raw": "raw", "tags-inline": "inline", "tags-semantic": "semantic", "tags-unique": "unique", "tags-parents-allow": "parents_allow", "tags-parents-direct": "parents_direct", "tag-attrs": "attrs", "tags-headers": "headers", "attr-headers": "attrs_headers"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("args", nargs="*", metavar="[mode] [input] [output]")
    p.add_argument("-m", "--mode", choices=MODES)
    p.add_argument("-f", "--format", default="auto")
    p.add_argument("-s", "--stream", choices=codec.STREAMS, help="default: apertium, or what the stream's header shows")
    p.add_argument("-d", "--dir", help="folder of the state, which is kept; default: a new one, named in the stream's header")
    p.add_argument("-k", "--keep", action="store_true", help="keep the state's folder after injection")
    p.add_argument("-K", "--no-keep", action="store_true", help="make the folder anew before extraction, and delete it after injection")
    p.add_argument("-i", "--input", default=None, help="default and -: standard input")
    p.add_argument("-o", "--output", default=None, help="default and -: standard output")
    p.add_argument("-H", "--mark-headers", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--debug", action="store_true", help="keep, in the state's folder, the markup that injection parses")
    p.add_argument("-V", "--version", action="version", version=VERSION)
    for flag in ("apertium-n", "inject-raw", "no-extend", "extract-more", "mangle-xml"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--hook-inject", help="program that edits each injected document in the file it is given")
    for flag in _TAGS:
        p.add_argument(f"--{flag}", help="comma list; + appends")
    for flag in ("url64", "hash32", "hash64"):
        p.add_argument(f"--{flag}", metavar="TEXT")
    return p


def hook(program: str) -> Callable[[str], str]:
    """A program that edits the file it is given, as a function of the document."""

    def run(text: str) -> str:
        with tempfile.TemporaryDirectory() as folder:
            path = os.path.join(folder, "injected")
            with open(path, "wb") as f:
                f.write(text.encode("utf-8", "surrogatepass"))
            subprocess.run([program, path], check=True)
            with open(path, "rb") as f:
                return f.read().decode("utf-8", "replace")

    return run


def settings_of(a: argparse.Namespace, stream: str) -> Settings:
    given = {c: getattr(a, f.replace("-", "_")) for f, c in _TAGS.items()}
    return Settings(a.format, stream, a.mark_headers, not a.no_extend, a.extract_more, a.mangle_xml, a.inject_raw, {c: v.split(",") for c, v in given.items() if v}, hook(a.hook_inject) if a.hook_inject else None)


def _read(spark: SparkSession, path: str) -> DataFrame:
    if path == "-":
        return spark.createDataFrame([(0, "", bytearray(sys.stdin.buffer.read()))], "doc_id long, name string, content binary")
    return read_files(spark, path)


@contextlib.contextmanager
def _out(path: str) -> Iterator[BinaryIO]:
    if path == "-":
        yield sys.stdout.buffer
        sys.stdout.flush()
    else:
        with open(path, "wb") as f:
            yield f


def _documents(rows: Iterator[Row], path: str) -> None:
    """Documents one after the other, one in memory at a time."""
    with _out(path) as f:
        for r in rows:
            f.write((r.text or "").encode("utf-8", "surrogatepass") if r.content is None else bytes(r.content))


def _value(a: argparse.Namespace) -> bytes | None:
    """What the options that only encode a text give."""
    if a.url64 is not None:
        raw = a.url64.encode()
    elif a.hash32 is not None:
        raw = xxhash.xxh32_intdigest(a.hash32.encode(), 0).to_bytes(4, "little")
    elif a.hash64 is not None:
        raw = xxhash.xxh64_intdigest(a.hash64.encode(), 0).to_bytes(8, "little")
    else:
        return None
    return base64.urlsafe_b64encode(raw).rstrip(b"=") + b"\n"


def _extract(spark: SparkSession, a: argparse.Namespace, source: str, target: str, say: Callable[..., None]) -> None:
    s, folder = settings_of(a, a.stream or "apertium"), a.dir or tempfile.mkdtemp(prefix="spanloom-")
    path = f"{folder}/extracted"
    say("State folder:", folder)
    if exists(spark, path) and not a.no_keep:
        say("Using the extraction that is there")
        state = engine.State.load(spark, path, s)
    else:
        state = engine.extract(_read(spark, source), s, content="content", name="name").save(path)
    name = F.concat(F.lit(f"{folder}#"), F.col("doc_id").cast("string"))
    streams = codec.encode(state.blocks, s.stream, name, without_stop=a.apertium_n)
    with _out(target) as f:
        for r in streams.orderBy("doc_id").toLocalIterator():
            f.write(r.stream.encode("utf-8", "surrogatepass"))


def _inject(spark: SparkSession, a: argparse.Namespace, source: str, target: str, say: Callable[..., None]) -> None:
    text = _read(spark, source).select(detect.decoded(F.col("content")).alias("stream"))
    head = text.select(codec.stream_kind(F.col("stream")).alias("kind"), codec.stream_name(F.col("stream")).alias("name")).filter("kind IS NOT NULL").first()
    if head is None and a.stream is None:
        raise SystemExit("the stream has no header that shows its format")
    stream, folder = a.stream or head.kind, a.dir or (head and head.name.rpartition("#")[0])
    say("Stream format:", stream)
    if not folder or not exists(spark, f"{folder}/extracted"):
        raise SystemExit(f"no state in {folder or 'the stream header'}")
    say("State folder:", folder)
    state = engine.State.load(spark, f"{folder}/extracted", settings_of(a, stream))
    each = codec.documents_of(text, "stream").select(F.substring_index("name", "#", -1).cast("long").alias("doc_id"), "stream")
    if stream == "apertium":
        got = codec.decode_apertium(codec.frames_of(each, "stream", "doc_id"), "value", "doc_id")
    else:
        got = codec.decode_visl(each, "stream", "doc_id", cg=stream == "cg").drop("seq")
    if a.debug:
        engine.filled(state, got).write.mode("overwrite").parquet(f"{folder}/debug-inject-filled")
    _documents(engine.inject(state, got).orderBy("doc_id").toLocalIterator(), target)
    if a.no_keep or not (a.keep or a.dir or a.debug):
        delete(spark, folder)


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_intermixed_args(argv)
    value = _value(a)
    free = list(a.args)
    mode = a.mode or (free.pop(0) if free and free[0] in MODES else None)
    source, target = (given or (free.pop(0) if free else "-") for given in (a.input, a.output))
    if value is not None:
        with _out(target if a.output else "-") as f:
            f.write(value)
        return 0
    if mode is None or free:
        p.error("a mode is needed: extract, inject or clean" if mode is None else f"too many arguments: {free}")
    spark = SparkSession.builder.appName("spanloom").getOrCreate()

    def say(*what: str) -> None:
        if a.verbose:
            print(*what, file=sys.stderr)

    if mode == "extract":
        _extract(spark, a, source, target, say)
    elif mode == "inject":
        _inject(spark, a, source, target, say)
    else:
        s = settings_of(a, a.stream or "apertium")
        _documents(engine.clean(_read(spark, source), s, content="content", name="name").toLocalIterator(), target)
    return 0


if __name__ == "__main__":
    sys.exit(main())
