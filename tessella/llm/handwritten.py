"""Telling files nobody wrote by hand: generated, built, minified, third-party or data saved as code."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.paths import base_name, clean_path
from tessella.operators.rows import latest
from tessella.operators.skew import present_in

#: Path markers by kind. A path is matched with a leading ``/`` and an end mark ``\n``.
MARKERS = {
    "vendored": (
        "/node_modules/", "/bower_components/", "/jspm_packages/", "/vendor/", "/_vendor/", "/third_party/", "/third-party/", "/thirdparty/", "/3rdparty/",
        "/Pods/", "/Carthage/", "/site-packages/", "/dist-packages/", "/.yarn/", "/.pnpm/", "/.venv/", "/venv/", "/Godeps/", "/.cargo/registry/",
    ),
    "generated": (
        "/__generated__/", "/generated/", "/build/generated/", "/build/libs/", "/build/classes/", "/build/intermediates/", "/_generated/", "/openapi_generated/", "/generated-sources/", "/generated-src/", "/generated_src/", "/autogen/",
        "/obj/Debug/", "/obj/Release/", "/target/debug/", "/target/release/", "/.next/", "/.nuxt/", "/.svelte-kit/", "/storybook-static/", "/__pycache__/",
        "_pb2.py\n", "_pb2_grpc.py\n", "_pb2.pyi\n", ".pb.go\n", ".pb.ts\n", ".pb.js\n", ".pb.cc\n", ".pb.h\n", ".pb.dart\n", "_grpc.pb.go\n", "_pb.js\n", "_pb.d.ts\n", "_pb.ts\n", ".pbobjc.m\n",
        ".g.dart\n", ".freezed.dart\n", ".gr.dart\n", ".mocks.dart\n", ".g.cs\n", ".g.i.cs\n", ".Designer.cs\n", ".designer.cs\n", ".Generated.cs\n",
        ".generated.", ".gen.ts\n", ".gen.tsx\n", ".gen.js\n", ".gen.go\n", ".gen.rs\n", ".gen.py\n", "_gen.go\n", "_generated.go\n", "_generated.rs\n", "_generated.py\n", "_generated.ts\n", "_generated.java\n", "_autogen.",
        "/zz_generated.", "/zz_generated_", "_AutoGen.", "OuterClass.java\n", "_bindgen.rs\n",
    ),
    "minified": (".min.js\n", ".min.mjs\n", ".min.cjs\n", ".min.css\n", "-min.js\n", "-min.mjs\n", "-min.css\n", ".bundle.js\n", ".bundle.mjs\n", ".chunk.js\n", ".bundle.css\n"),
    "lockfile": (
        "/package-lock.json\n", "/npm-shrinkwrap.json\n", "/yarn.lock\n", "/pnpm-lock.yaml\n", "/Cargo.lock\n", "/poetry.lock\n", "/Pipfile.lock\n", "/uv.lock\n", "/composer.lock\n", "/Gemfile.lock\n", "/go.sum\n", "/pubspec.lock\n", "/packages.lock.json\n", "/gradle.lockfile\n",
    ),
}

#: Notices that tools write into the head of a file, in lower case.
NOTICES = (
    "@generated", "<auto-generated", "auto-generated file", "autogenerated file", "automatically generated by", "automatically generated file", "this file is generated", "this file was generated", "this file is automatically generated",
    "this file was automatically generated", "code generated by", "generated by the protocol buffer compiler", "do not edit!", "do not edit this file", "do not edit manually", "do not modify this file", "generated code -- do not edit", "generated file, do not edit", "generated from openapi",
)

#: A third-party release unpacked below ``external`` carries its version; build output of a package; hashed bundle names.
_RELEASE = r"/(external|externals|extern)/[^/]+[-@]v?\d+(\.\d+)+[^/]*/"
_BUILT = r"/dist/([^/]+/)*[^/]+\.(js|mjs|cjs|css|map)$"
_HASHED = r"[.-](?=[0-9a-fA-F]*\d)[0-9a-fA-F]{8,}\.(js|mjs|cjs|css)$"

#: Hand-written code has some dozens of bytes a line; from here on a large file is one long literal or squeezed code.
BYTES_A_LINE = 500
LARGE = 100_000
SHORT_NAME = 2.5
FEW_LINES = 3


def _automaton(groups: dict[str, tuple[str, ...]]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in groups.items():
        for word in words:
            found.add_word(word, kind)
    found.make_automaton()
    return found


def marker_kind(path: Column) -> Column:
    """The first of vendored, generated, minified, lockfile whose markers occur in a cleaned path, else null.

    One pass of a multi-pattern automaton over each path, in batches.
    """
    order = list(MARKERS)

    @F.pandas_udf("string")
    def kinds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        auto = _automaton(MARKERS)
        for paths in batches:
            yield pd.Series([None if p is None else min({k for _, k in auto.iter(f"/{p}\n")}, key=order.index, default=None) for p in paths])

    return kinds(path)


def has_notice(text: Column, head: int | None = None) -> Column:
    """Whether a text holds a generation notice, found by one automaton; ``head`` limits it to so many characters."""

    @F.pandas_udf("boolean")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        auto = _automaton({"notice": NOTICES})
        for texts in batches:
            yield pd.Series([bool(t) and next(auto.iter((t[:head] if head else t).lower()), None) is not None for t in texts])

    return found(text)


def classify(files: DataFrame, symbols: DataFrame, header: str | None = None) -> DataFrame:
    """``file_id, file_path, reason`` for every file; ``reason`` is null where a file counts as hand-written.

    Evidence, in this order: ``vendored`` (path rules), ``third_party_copy`` (the content hash of a non-empty vendored file, wherever the copy
    lies), ``generated`` (path rules; a notice in the column ``header`` if one is named), ``minified`` (names, or symbols of one or two letters on
    the first lines), ``lockfile``, ``data`` (a large file of very few lines that defines next to nothing). Of a file
    delivered more than once the latest ``last_indexed_at`` holds; a null path, size or hash gives no evidence; files without
    symbols are judged by the rest.
    """
    columns = ["id", "path", "size", "hash", "last_indexed_at", *([header] if header else [])]
    heads = latest(files.where(F.col("id").isNotNull()).select(*columns), ["id"], ["last_indexed_at"]).withColumn("p", clean_path(F.col("path")))
    shape = (
        latest(symbols.select("id", "file_id", "name", "line"), ["id"])
        .where(F.col("file_id").isNotNull())
        .groupBy(F.col("file_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("name")).alias("len"), F.max("line").alias("lines"))
    )
    named = F.concat(F.lit("/"), F.col("p"))
    marked = heads.withColumn("mark", marker_kind(F.col("p"))).withColumn(
        "mark",
        F.when((F.col("mark") == "vendored") | named.rlike(_RELEASE), "vendored")
        .when((F.col("mark") == "generated") | named.rlike(_BUILT), "generated")
        .when((F.col("mark") == "minified") | base_name(F.col("p")).rlike(_HASHED), "minified")
        .otherwise(F.col("mark")),
    )
    # Empty files share one hash; where any file of a hash is empty, the hash says nothing.
    empty = heads.where("size = 0").select(F.col("hash").alias("e")).where("e is not null").distinct()
    foreign = marked.where("mark = 'vendored' and hash is not null").select(F.col("hash").alias("h")).distinct()
    foreign = foreign.join(empty, F.col("h") == F.col("e"), "left_anti")
    copies = present_in(heads.select("id", "hash"), "hash", foreign, "h").select("id", F.lit(True).alias("copied"))
    lines = F.greatest(F.coalesce("lines", F.lit(1)), F.lit(1))
    squeezed = (F.col("n") >= 3) & (F.col("len") <= SHORT_NAME) & (lines <= FEW_LINES)
    literal = (F.col("size") >= LARGE) & (F.col("size") / lines >= BYTES_A_LINE)
    noticed = has_notice(F.col(header)) if header else F.lit(False)
    return (
        marked.join(shape, "id", "left")
        .join(copies, "id", "left")
        .select(
            F.col("id").alias("file_id"),
            F.col("p").alias("file_path"),
            F.when(F.col("mark") == "vendored", "vendored")
            .when(F.col("copied"), "third_party_copy")
            .when((F.col("mark") == "generated") | noticed, "generated")
            .when((F.col("mark") == "minified") | squeezed, "minified")
            .when(F.col("mark") == "lockfile", "lockfile")
            .when(literal, "data")
            .alias("reason"),
        )
    )
