"""Files: JSON, CSV sheets, XML (also compressed), raw bytes, cached scans."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.rules.entries import WHOLE as ENTRY
from florilege.sources import xmlparts


def json_snapshot(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON array or objects; with a schema, rows that don't fit keep their text in _corrupt_record."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def sheet(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    """The first CSV sheet that exists, its first row the header (blank names become Col1, Col2 ...), rows of nulls dropped."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        p = hadoop(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            df = spark.read.option("header", True).option("multiLine", True).csv(path)
            df = df.toDF(*[f"Col{i + 1}" if re.fullmatch(r"_c\d+", c) or not c.strip() else c.strip() for i, c in enumerate(df.columns)])
            if columns and df.columns != columns:
                raise ValueError(f"columns {df.columns}, expected {columns}")
            return df.na.drop(how="all")
    raise FileNotFoundError(", ".join(paths))


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at path, made and written if it isn't there or if force is set."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if force or not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _local(name: str) -> str:
    return name.rsplit("}", 1)[-1]


def _text(node) -> str:
    return " ".join("".join(node.itertext()).split())


def entry_of(node) -> dict:
    """The fields of an entry element, whatever its namespaces."""
    attribute = lambda n, name: next((v for k, v in n.attrib.items() if _local(k) == name), None)
    children = lambda n, name: [c for c in n if _local(c.tag) == name]
    below = lambda name: [c for c in node.iter() if isinstance(c.tag, str) and _local(c.tag) == name]
    senses = [{"id": attribute(s, "id") or "", "n": attribute(s, "n"), "defs": [_text(d) for d in children(s, "def")]} for s in children(node, "sense")]
    dated = {"forValidation", "revisto", "revised", "date"}
    return {
        "entry_id": attribute(node, "id") or "",
        "volp": attribute(node, "volp"),
        "orths": [_text(o) for f in children(node, "form") for o in children(f, "orth")],
        "senses": senses,
        "refs": ["".join(r.itertext()) for r in below("ref") if r.get("type") == "entry"],
        "dates": [v for c in node.iter() if isinstance(c.tag, str) for k, v in c.attrib.items() if _local(k) in dated],
        "grams": [_text(g) for g in below("gramGrp")],
        "ids": [v for c in node.iter() if isinstance(c.tag, str) for k, v in c.attrib.items() if _local(k) == "id"],
        "all_defs": len(below("def")),
    }


def xml_entries(spark: SparkSession, path: str, tag: str = "entry", split: int = xmlparts.SPLIT_BYTES) -> DataFrame:
    """Entries of XML files, plain, .gz or .xz, split into ranges; a file that breaks off gives what came before, and xml_errors
    tells that it does."""
    return parsed_entries(xmlparts.read(spark, path, tag, split=split)).where("error IS NULL").drop("path", "error")


def xml_errors(spark: SparkSession, path: str, tag: str = "entry", split: int = xmlparts.SPLIT_BYTES) -> DataFrame:
    """(path, error): files that can't be read to their end, and entries that can't be parsed."""
    return parsed_entries(xmlparts.read(spark, path, tag, split=split)).where("error IS NOT NULL").select("path", "error")


def parsed_entries(rows: DataFrame) -> DataFrame:
    """Entries of (path, xml, error), each xml one entry element, with path and error."""
    names = [f.split()[0] for f in ENTRY.split(", ")]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, xml, error in zip(frame["path"], frame["xml"], frame["error"], strict=True):
                fields = dict.fromkeys(names)
                if error is None:
                    try:
                        fields = entry_of(ElementTree.fromstring(xml))
                    except ElementTree.ParseError as e:
                        error = f"ParseError: {e}"
                rows.append(fields | {"path": path, "error": error})
            if rows:
                yield pd.DataFrame(rows)

    return rows.select("path", "xml", "error").mapInPandas(parse, f"{ENTRY}, path string, error string")


def xml_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Elements of plain XML files by Spark's own splittable reader."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def processing_instructions(spark: SparkSession, path: str, name: str = "xml-model", split: int = xmlparts.SPLIT_BYTES) -> DataFrame:
    """(signature, n) of the processing instructions of that name, wherever they stand: their attributes by name."""
    bodies = xmlparts.read(spark, path, name, "instructions", split).where("error IS NULL")
    found = F.regexp_extract_all("xml", F.lit(r"""([A-Za-z_:][-A-Za-z0-9_:.]*)\s*=\s*(?s:'.*?'|".*?")"""), F.lit(0))
    pairs = F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^([^\s=]+)", 1).alias("k"), F.regexp_extract(x, r"""(?s)=\s*['"](.*)['"]$""", 1).alias("v")))
    # of repeated attributes the last one counts
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    signature = F.array_join(F.transform(F.array_sort(last), lambda x: F.concat(x["k"], F.lit("="), x["v"])), " | ")
    return bodies.groupBy(signature.alias("signature")).agg(F.count("*").alias("n"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
