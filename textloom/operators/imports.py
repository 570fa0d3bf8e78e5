"""What names what: files that nothing mentions, imports of deleted or missing files and what they may have meant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import names as N
from textloom.functions.substrings import containing, endings, holders
from textloom.functions.text import line_array
from textloom.operators.catalog import report
from textloom.session import cut

#: Endings and parts of paths that a program starts from (fixed values).
ENTRY_ENDS = ("/main.rs", "/lib.rs", "/mod.rs", "/main.tsx", "/index.ts", "/index.tsx")
ENTRY_PART = "/tests/"
#: What every line of a forwarding file begins with, and its lines at most (fixed values).
FORWARDING = ("export ", "pub use ", "pub mod ", "mod ")
FORWARDING_LINES = 5


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def stem(path: Column) -> Column:
    """A file's name without its extension; a name of an extension alone is its own stem."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def is_entry(path: Column) -> Column:
    out = F.contains(path, F.lit(ENTRY_PART))
    for end in ENTRY_ENDS:
        out = out | path.endswith(end)
    return out


def is_forwarding(text: Column) -> Column:
    """Whether a file only forwards to others, or is empty."""
    solid = F.filter(F.transform(line_array(text), F.trim), lambda x: x != "")
    starts = lambda x: F.array_contains(F.transform(F.array(*map(F.lit, FORWARDING)), lambda p: F.startswith(x, p)), True)
    return (F.size(solid) <= FORWARDING_LINES) & F.forall(solid, starts)


def text_refs(files: DataFrame) -> DataFrame:
    """file_id, stem_refs, name_refs, path_refs: other files whose texts contain a file's stem, name or whole path.

    Texts are counted for each string before they meet the files of that name, so a
    name of many files is one row. A file's own text does not count.
    """
    each = F.array(*[F.struct(F.lit(k).alias("kind"), f(F.col("path")).alias("needle")) for k, f in (("stem", stem), ("name", file_name), ("path", lambda p: p))])
    own = files.select("file_id", F.explode(each).alias("x")).select("file_id", "x.kind", "x.needle")
    found = holders(files, own)
    counts = found.groupBy("needle").agg(F.count(F.lit(1)).alias("n"))
    itself = found.join(own, ["file_id", "needle"]).select("file_id", "kind", F.lit(1).alias("itself"))
    refs = own.join(counts, "needle", "left").join(itself, ["file_id", "kind"], "left")
    n = F.coalesce("n", F.lit(0)) - F.coalesce("itself", F.lit(0))
    of = lambda kind: F.max(F.when(F.col("kind") == kind, n)).alias(f"{kind}_refs")
    return refs.groupBy("file_id").agg(of("stem"), of("name"), of("path"))


def orphans(files: DataFrame, dependencies: DataFrame, prefix: str = "") -> DataFrame:
    """path, lines, refs, status of the files under ``prefix`` that no program starts from.

    refs: files that import it, and other files whose text contains its stem (and so its
    name or path). status: ``referenced``, ``forwarding`` if nothing refers to it and it
    only forwards, else ``orphan``. Null paths: left out.
    """
    inbound = dependencies.groupBy(F.col("target").alias("file_id")).agg(F.count(F.lit(1)).alias("inbound"))
    mine = files.filter(F.startswith("path", F.lit(prefix)) & ~is_entry(F.col("path")))
    rows = mine.select("file_id", "path", "lines", is_forwarding(F.col("text")).alias("forwards")).join(text_refs(files), "file_id").join(inbound, "file_id", "left")
    refs = F.coalesce("inbound", F.lit(0)) + F.greatest("stem_refs", "name_refs", "path_refs")
    status = F.when(refs > 0, "referenced").when(F.col("forwards"), "forwarding").otherwise("orphan")
    return rows.select("path", "lines", refs.alias("refs"), status.alias("status"))


@report("files dependencies", r"""WITH n AS (SELECT file_id, path, lines, regexp_extract(path, '[^/]*$') AS name, regexp_replace(regexp_extract(path, '[^/]*$'), '(.)[.][^.]*$', '\1') AS stem, text FROM files),
i AS (SELECT target AS file_id, count(*) AS n FROM dependencies GROUP BY target),
r AS (SELECT a.file_id, count(*) AS n FROM n a JOIN files b ON b.file_id <> a.file_id AND contains(b.text, a.stem) GROUP BY a.file_id),
k AS (SELECT n.*, coalesce(i.n, 0) + coalesce(r.n, 0) AS refs, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS solid FROM n LEFT JOIN i USING (file_id) LEFT JOIN r USING (file_id))
SELECT path, lines, refs::BIGINT AS refs, CASE WHEN refs > 0 THEN 'referenced' WHEN len(solid) <= 5 AND len(list_filter(solid, lambda x: NOT regexp_matches(x, '^(export|pub use|pub mod|mod) '))) = 0 THEN 'forwarding' ELSE 'orphan' END AS status
FROM k WHERE NOT regexp_matches(path, '/(main.rs|lib.rs|mod.rs|main.tsx|index.ts|index.tsx)$|/tests/')""")
def orphan_files(rel, prefix: str = ""):
    return orphans(rel.files, rel.dependencies, prefix)


_SEGMENT = "regexp_extract(specifier, '[^/]*$')"


@report("files imports", f"""WITH n AS (SELECT DISTINCT {_SEGMENT} AS needle FROM imports WHERE {_SEGMENT} <> '')
SELECT needle, count(*) AS files FROM n JOIN files ON contains(text, needle) GROUP BY needle""")
def link_names_in_texts(rel):
    """How many files contain the last part of each link, as it stands, inside words or not."""
    needles = rel.imports.select(file_name(F.col("specifier")).alias("needle"))
    return holders(rel.files, needles).groupBy("needle").agg(F.count(F.lit(1)).alias("files"))


def last_part(specifier: Column) -> Column:
    """What a specifier names: its last part, without the steps before it."""
    return file_name(F.regexp_replace(specifier, r"^(\./)*(\.\./)*", ""))


def guessed(specifiers: DataFrame, paths: DataFrame) -> DataFrame:
    """specifier, candidate: the first path, by ``ord``, that contains a specifier's last part; none if no path does."""
    parts = specifiers.select("specifier").distinct().withColumn("needle", last_part(F.col("specifier")))
    hit = containing(parts, paths.select(F.col("path").alias("name"), "ord")).groupBy("needle").agg(F.min_by("name", F.struct("ord", "name")).alias("candidate"))
    return parts.join(hit, "needle", "left").select("specifier", "candidate")


@report("imports", f"""WITH n AS (SELECT DISTINCT specifier, {_SEGMENT} AS needle FROM imports)
SELECT specifier, (SELECT arg_min(url, page_id) FROM pages p WHERE needle <> '' AND contains(p.url, needle)) AS candidate FROM n""")
def guessed_pages(rel):
    """The first page whose address contains the last part of a link."""
    return guessed(rel.imports, rel.read("pages").select(F.col("url").alias("path"), F.col("page_id").alias("ord")))


def deleted_targets(tries: DataFrame, deleted: DataFrame) -> DataFrame:
    """tries (key, candidate) with ``deleted``: the deleted path that ends with a candidate, whole folders only.

    Every deleted path lists its endings; a candidate meets them by equality. Of several
    paths the one with the least before the candidate counts, then the first by name.
    """
    listed = deleted.select("path", F.explode(endings(F.col("path"))).alias("candidate"))
    best = F.min_by("path", F.struct(F.length("path") - F.length("candidate"), F.col("path"))).alias("deleted")
    return tries.join(listed, "candidate").groupBy("key").agg(best)


def check_imports(imports: DataFrame, files: DataFrame, status: DataFrame, changed_only: bool = False) -> DataFrame:
    """path, line, specifier, finding, target, candidate, reach of every relative import.

    imports: path (of the importing file), line, specifier; files: path, ord; status:
    status, path of what version control calls changed. finding: ``found``; ``stale`` if what it
    means is deleted, whether a file or not; ``broken`` if there is no such file, with the
    first TypeScript file that contains its last part as ``candidate``. reach: ``deep`` if it climbs two folders.
    """
    rows, relative = imports, F.startswith("specifier", F.lit("."))
    if changed_only:
        rows = rows.join(status.select("path").distinct(), "path", "left_semi")
    # what an import means depends on the file it leads to alone: each such file is looked for once, however many name it
    rows = cut(rows.select("path", "line", "specifier", F.when(relative, N.module_base(F.col("path"), F.col("specifier"))).alias("base"))).filter(relative)
    tries = rows.select("base").distinct().select("base", F.posexplode(N.candidates(F.col("base"))).alias("preference", "candidate"))
    gone = status.filter("status = 'D'").select("path").distinct()
    known = files.select(F.col("path").alias("candidate")).distinct().join(gone.select(F.col("path").alias("candidate"), F.lit(True).alias("gone")), "candidate", "left")
    hit = tries.join(known, "candidate").groupBy("base").agg(F.min_by(F.struct("candidate", "gone"), "preference").alias("hit"))
    lost = deleted_targets(tries.select(F.col("base").alias("key"), "candidate"), gone).withColumnRenamed("key", "base")
    finding = F.when(F.col("hit").isNotNull(), F.when(F.col("hit.gone"), "stale").otherwise("found")).when(F.col("deleted").isNotNull(), "stale").otherwise("broken")
    meant = cut(rows.select("base").distinct().join(hit, "base", "left").join(lost, "base", "left").select("base", finding.alias("finding"), F.coalesce("hit.candidate", "deleted").alias("target")))
    broken = meant.filter("finding = 'broken'").select("base")
    rows = rows.join(meant, "base", "left").withColumn("finding", F.coalesce("finding", F.lit("broken")))
    if broken.isEmpty():
        rows = rows.withColumn("candidate", F.lit(None).cast("string"))
    else:
        typed = files.filter(F.col("path").endswith(".ts") | F.col("path").endswith(".tsx"))
        guess = guessed(rows.filter("finding = 'broken'").select("specifier"), typed.select("path", "ord"))
        rows = rows.join(guess, "specifier", "left")
    climbs = F.regexp_count("specifier", F.lit(r"\.\./"))
    return rows.select(
        "path", "line", "specifier", "finding", F.when(F.col("finding") != "broken", F.col("target")).alias("target"),
        F.when(F.col("finding") == "broken", F.col("candidate")).alias("candidate"), F.when(climbs >= 2, "deep").otherwise("flat").alias("reach"),
    )


@report("files changed dependencies", """WITH p AS (SELECT file_id, path, status = 'D' AS gone FROM files LEFT JOIN changed USING (file_id))
SELECT a.path, b.path AS target, CASE WHEN b.gone THEN 'stale' ELSE 'found' END AS finding, CASE WHEN split_part(a.path, '/', 3) <> split_part(b.path, '/', 3) THEN 'deep' ELSE 'flat' END AS reach
FROM dependencies d JOIN p a ON a.file_id = d.source JOIN p b ON b.file_id = d.target WHERE a.path <> b.path""")
def stale_imports(rel):
    """Dependencies as the specifiers that would name them, resolved again among the files that are left and those deleted."""
    path = rel.files.select("file_id", "path", "ord")
    edges = rel.dependencies.join(path.select(F.col("file_id").alias("source"), "path"), "source").join(path.select(F.col("file_id").alias("target"), F.col("path").alias("to")), "target")
    edges = edges.filter("path <> to").select("path", F.lit(1).alias("line"), N.relative_module(F.col("path"), F.col("to")).alias("specifier"))
    status = rel.changed.join(path, "file_id").select("status", "path")
    left = path.join(status.filter("status = 'D'").select("path"), "path", "left_anti")
    return check_imports(edges, left, status).select("path", "target", "finding", "reach")
