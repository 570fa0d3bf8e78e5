"""The relations that every report reads, bound to a body of documents.

A body of text files becomes typed relations: files, packages, changes, symbols,
occurrences, anchors, dependencies and imports. Sources of code bring their own
rows of the same columns; ``bind`` makes them from the driver's tables. Every
relation is lazy, so a report only computes the columns it reads.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import line_array
from textloom.session import table

ROOT = "crates/apps/"
#: Dependencies that a task makes distinct, about.
EDGES_OF_A_TASK = 250_000


@dataclass(frozen=True)
class Relations:
    spark: SparkSession
    sf_dir: str

    def read(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def spread(self) -> int:
        """Files that symbols and anchors are spread over: all of them."""
        return max(1, self.read("documents").count())

    @cached_property
    def files(self) -> DataFrame:
        """file_id, ord, path, language, package, lines, size, hash, text."""
        docs = self.read("documents")
        return docs.select(
            F.concat(F.lit("f"), F.col("doc_id")).alias("file_id"),
            F.col("doc_id").alias("ord"),
            F.concat(F.lit(ROOT), "source", F.lit("/src/"), "lang", F.lit("/d"), "doc_id", F.lit(".txt")).alias("path"),
            F.col("lang").alias("language"),
            F.col("source").alias("package"),
            F.size(line_array("text")).cast("bigint").alias("lines"),
            F.octet_length("text").cast("bigint").alias("size"),
            F.substring(F.sha2("text", 256), 1, 8).alias("hash"),
            "text",
        )

    @cached_property
    def packages(self) -> DataFrame:
        """name, kind, prefix."""
        names = self.read("documents").select(F.col("source").alias("name")).distinct()
        kind = F.when(F.length("name") > 4, "library").otherwise("app")
        return names.select("name", kind.alias("kind"), F.concat(F.lit(ROOT), "name").alias("prefix"))

    @cached_property
    def changed(self) -> DataFrame:
        """file_id, status (D, A or M)."""
        status = F.when(F.col("toxic") == 1, "D").when(F.col("quality") == 0, "A").otherwise("M")
        return self.read("labels").select(F.concat(F.lit("f"), F.col("doc_id")).alias("file_id"), status.alias("status"))

    @cached_property
    def symbols(self) -> DataFrame:
        """name, kind, owner, visibility, file_id, line, line_end, line_count, body_open_line, body_close_line, ord."""
        line = F.col("p_size").cast("bigint")
        visibility = F.when(F.col("p_size") % 3 == 0, "pub").when(F.col("p_size") % 3 == 1, "export").otherwise("private")
        kind = F.when(F.col("p_partkey") % 4 == 0, "component").when(F.col("p_partkey") % 4 == 1, "fn").when(F.col("p_partkey") % 4 == 2, "method").otherwise("type")
        return self.read("part").select(
            F.col("p_name").alias("name"),
            kind.alias("kind"),
            F.col("p_brand").alias("owner"),
            visibility.alias("visibility"),
            F.concat(F.lit("f"), F.col("p_partkey") % self.spread).alias("file_id"),
            line.alias("line"),
            (line + F.col("p_partkey") % 10).alias("line_end"),
            (F.col("p_partkey") % 10 + 1).alias("line_count"),
            F.when(F.col("p_partkey") % 5 != 0, line).alias("body_open_line"),
            (line + F.col("p_partkey") % 10).alias("body_close_line"),
            F.col("p_partkey").alias("ord"),
        )

    @cached_property
    def occurrences(self) -> DataFrame:
        """value, kind, file_id, line, context, ord: notable tokens of lines."""
        from textloom.functions.text import lines

        pattern = r"[A-Z][A-Z]+|Licensed|License"
        found = lines(self.files, "file_id", "ord").withColumn("value", F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(0))))
        kind = F.when(F.col("value").rlike("^[A-Z]+$"), "constant").otherwise("license")
        return found.select("value", kind.alias("kind"), "file_id", "ord", "line_no", F.col("line").alias("context"))

    @cached_property
    def anchors(self) -> DataFrame:
        """anchor, domain, role, priority, file_id, line, ord; some without domain or priority."""
        priority = (
            F.when(F.col("value") < 20, "P0").when(F.col("value") < 40, "P1").when(F.col("value") < 60, "P2").when(F.col("value") < 80, "P3").when(F.col("value") < 100, "PX")
        )
        role = F.element_at(F.array(*map(F.lit, ("entry", "store", "view", "helper"))), (F.col("user_id") % 5 + 1).cast("int"))
        domain = F.when(F.col("user_id") % 7 != 0, F.col("event_type"))
        return self.read("events").select(
            F.concat("event_type", F.lit("-"), F.col("user_id")).alias("anchor"),
            domain.alias("domain"),
            F.when(F.col("user_id") % 5 < 4, role).alias("role"),
            priority.alias("priority"),
            F.concat(F.lit("f"), F.col("user_id") % self.spread).alias("file_id"),
            (F.col("event_id") % 300).alias("line"),
            F.col("event_id").alias("ord"),
        )

    @cached_property
    def dependencies(self) -> DataFrame:
        """source, target, kind."""
        imports = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)
        rows = self.read("lineitem")
        edges = rows.select("l_suppkey", "l_partkey", imports.alias("imports"))
        # as many tasks as rows need, so that the table a task holds does not grow with them
        edges = edges.repartition(max(1, rows.count() // EDGES_OF_A_TASK), "l_suppkey", "l_partkey").distinct()  # of numbers, not of names
        return edges.select(F.concat(F.lit("f"), "l_suppkey").alias("source"), F.concat(F.lit("f"), "l_partkey").alias("target"), F.when(F.col("imports"), "imports").otherwise("uses").alias("kind"))

    @cached_property
    def imports(self) -> DataFrame:
        """page_id, url, specifier, ord: links out of pages."""
        pages = self.read("pages")
        links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
        return pages.select("page_id", "url", F.posexplode(links).alias("ord", "specifier"))
