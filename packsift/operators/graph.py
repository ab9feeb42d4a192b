"""File roles and the dependency graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import signals as S
from ..functions.paths import is_local, manifest_path, parent_of, resolve, suffixes
from ..functions.text import all_hits, any_of, first_of, js
from ..session import cut_growing, growing

# --- fixed values: manifest slots and their roles; a later slot overrides an earlier one --
_SLOTS = [
    ("content_js", "content_script", True), ("background", "background", True),
    ("service_worker", "background", False), ("popup", "popup", False),
    ("options", "options_ui", False), ("devtools", "devtools", False),
    ("side_panel", "side_panel", False), ("sandbox", "sandbox", True),
    ("overrides", "override_page", True),
]


def manifest_references(manifests: DataFrame) -> DataFrame:
    """(ext_id, slot, role, reference) for every file a manifest names."""
    def entries(rank: int, column: str, role: str, many: bool) -> Column:
        values = F.col(column) if many else F.array(F.col(column))
        return F.transform(values, lambda v: F.struct(
            F.lit(rank).alias("slot"), F.lit(role).alias("role"), v.alias("reference")))

    every = F.concat(*[entries(i, *slot) for i, slot in enumerate(_SLOTS)])
    return (
        manifests.select("ext_id", F.explode(every).alias("e")).select("ext_id", "e.*")
        .filter(F.coalesce(F.col("reference"), F.lit("")) != "")
        .withColumn("reference", F.regexp_replace("reference", r"\\", "/"))
    )


def page_scripts(manifests: DataFrame, texts: DataFrame) -> DataFrame:
    """(ext_id, page, role, src, path) for scripts of the pages a manifest names."""
    pages = manifest_references(manifests).filter(
        F.col("role").isin("popup", "options_ui", "devtools", "side_panel", "sandbox", "override_page"))
    found = (
        pages.join(texts.select("ext_id", F.col("path").alias("reference"), "text"), ["ext_id", "reference"])
        .select("ext_id", F.col("reference").alias("page"), "role", "slot",
                F.explode(all_hits(F.col("text"), S.HTML_SCRIPT_JS, 1)).alias("src"))
    )
    folder = parent_of(F.col("page"))
    local = F.when(F.col("src").startswith("/"), F.substr("src", F.lit(2))).when(
        folder == "", F.col("src")).otherwise(F.concat(folder, F.lit("/"), F.col("src")))
    return found.withColumn("path", F.when(~F.col("src").rlike("^https?://"), local))


def remote_scripts(manifests: DataFrame, texts: DataFrame) -> DataFrame:
    """Scripts that manifest pages load from elsewhere."""
    return page_scripts(manifests, texts).filter(F.col("path").isNull()).select("ext_id", "page", "role", "src")


def path_role(path: Column) -> Column:
    """Role read off the path alone, in fixed precedence."""
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    low = F.lower(path)
    has = low.contains
    return first_of([
        (any_of(base.startswith(lib) for lib in S.KNOWN_LIBRARIES), "library"),
        (has("/popup/") | low.startswith("popup/") | (low == "popup.js"), "popup"),
        (has("options") | has("settings"), "options_ui"),
        (has("devtools") | has("panel"), "devtools"),
        (has("sandbox"), "sandbox"),
        (has("background") | has("service-worker") | has("serviceworker"), "background"),
        (has("/content") | has("content-script") | has("contentscript"), "content_script"),
        (path.rlike(S.INJECTOR_FILE), "content_script"),
        (F.lit(True), "unknown"),
    ])


def file_roles(scripts: DataFrame, manifests: DataFrame, texts: DataFrame) -> DataFrame:
    """Role per script: manifest slot (exact or path suffix), page inheritance, path.

    Suffixes of each path are exploded and equi-joined, so the cost follows path depth and
    no file is compared with every manifest entry.
    """
    # A path named by several slots keeps the last slot's role at the first slot's rank.
    named = (
        manifest_references(manifests).groupBy("ext_id", "reference")
        .agg(F.min("slot").alias("slot"), F.max(F.struct("slot", "role")).alias("last"))
        .select("ext_id", "reference", "slot", F.col("last.role").alias("role"))
    )
    inherited = (
        page_scripts(manifests, texts).filter(F.col("path").isNotNull())
        .groupBy("ext_id", F.col("path").alias("reference"))
        .agg(F.min(F.struct("slot", "role")).alias("first"))
        .select("ext_id", "reference", (F.col("first.slot") + 100).alias("slot"), F.col("first.role").alias("role"))
    )
    slots = growing(named.unionByName(inherited))
    keyed = scripts.select("ext_id", "path", F.explode(suffixes(F.col("path"), "/")).alias("reference"))
    matched = (
        keyed.join(slots, ["ext_id", "reference"])
        .groupBy("ext_id", "path").agg(F.min(F.struct("slot", "reference", "role")).alias("best"))
        .select("ext_id", "path", F.col("best.role").alias("mapped"))
    )
    return scripts.join(growing(matched), ["ext_id", "path"], "left").withColumn(
        "role", F.coalesce("mapped", path_role(F.col("path")))).drop("mapped")


def script_edges(lines: DataFrame) -> DataFrame:
    """Local dependency edges of code lines, one row per reference."""
    text, folder = F.col("text"), parent_of(F.col("path"))

    def tagged(kind: str, pattern: str) -> Column:
        return F.transform(all_hits(text, pattern, 1),
                           lambda target: F.struct(F.lit(kind).alias("type"), target.alias("target")))

    found = F.concat(*[tagged(*row) for row in S.LINE_DEPENDENCIES])
    return (
        lines.filter(text.rlike(r"import|require|Worker|\.src"))
        .select("ext_id", "path", "line", F.explode(found).alias("e"))
        .filter(is_local(F.col("e.target")))
        .select("ext_id", F.col("path").alias("src"), resolve(folder, F.col("e.target")).alias("dst"),
                F.col("e.type").alias("type"), "line")
    )


def _placed(text: Column, pattern: str) -> Column:
    """(line, hit) of every hit of a pattern in a text, by counting the line feeds before it."""
    feeds = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    hits = F.regexp_extract_all(text, F.lit(js(pattern)), F.lit(0))
    gaps = F.transform(F.split(text, js(pattern), -1), feeds)
    inside = F.transform(hits, feeds)
    total = lambda parts: F.aggregate(parts, F.lit(1), lambda n, x: n + x)
    return F.transform(hits, lambda hit, i: F.struct(
        (total(F.slice(gaps, 1, i + 1)) + total(F.slice(inside, 1, i)) - 1).alias("line"), hit.alias("hit")))


def injected_file_edges(files: DataFrame) -> DataFrame:
    """Edges of ``files: [...]`` arrays, which may span lines."""
    inside = F.regexp_extract("b.hit", r"\[([^\]]*)\]", 1)
    return (
        files.filter(F.col("code").contains("files"))
        .select("ext_id", "path", F.explode(_placed(F.col("code"), S.INJECTED_FILES)).alias("b"))
        .select("ext_id", "path", "b.line", F.explode(F.regexp_extract_all(inside, F.lit(S.QUOTED), F.lit(1))).alias("target"))
        .filter(is_local(F.col("target")))
        .select("ext_id", F.col("path").alias("src"),
                resolve(parent_of(F.col("path")), F.col("target")).alias("dst"),
                F.lit("injected_file").alias("type"), "line")
    )


def html_edges(texts: DataFrame) -> DataFrame:
    """``<script src>`` edges of every HTML file; remote targets keep their URL."""
    return (
        texts.filter(F.col("path").rlike(r"(?i)\.html?$"))
        .select("ext_id", "path", F.explode(_placed(F.col("text"), S.HTML_SCRIPT)).alias("t"))
        .select("ext_id", "path", F.regexp_extract("t.hit", js(S.HTML_SCRIPT), 1).alias("target"), "t.line")
        .select("ext_id", F.col("path").alias("src"),
                F.when(F.col("target").rlike("(?i)^https?://"), F.col("target"))
                .otherwise(resolve(parent_of(F.col("path")), F.col("target"))).alias("dst"),
                F.lit("html_script").alias("type"), "line")
    )


def manifest_edges(manifests: DataFrame) -> DataFrame:
    every = F.concat("content_js", "content_css", "background", F.array("service_worker"), F.array("popup"),
                     F.array("options"), F.array("devtools"), F.array("side_panel"), "sandbox", "overrides",
                     "rule_files")
    return (
        manifests.select("ext_id", F.explode(every).alias("reference"))
        .select("ext_id", F.lit("manifest.json").alias("src"), manifest_path(F.col("reference")).alias("dst"),
                F.lit("manifest").alias("type"), F.lit(1).alias("line"))
        .filter(F.col("dst").isNotNull()).distinct()
    )


def dependency_edges(manifests: DataFrame, texts: DataFrame, lines: DataFrame, files: DataFrame) -> DataFrame:
    return (
        manifest_edges(manifests).unionByName(html_edges(texts))
        .unionByName(script_edges(lines)).unionByName(injected_file_edges(files))
    )


def unresolved(edges: DataFrame, inventory: DataFrame) -> DataFrame:
    """Local references from pages and scripts to files that are not in the package."""
    local = edges.filter((F.col("type") != "manifest") & ~F.col("dst").startswith("http"))
    present = inventory.select("ext_id", F.col("path").alias("dst"))
    return local.join(present, ["ext_id", "dst"], "left_anti")


def reachable(edges: DataFrame, inventory: DataFrame) -> DataFrame:
    """Files reachable from the manifest, for all packages at once.

    Breadth-first by joins: each round expands the frontier and drops what was visited.
    Rounds follow the longest import chain, not the data size, and end when a round finds
    nothing new. Each round's frontier is staged, so a lost executor never replays the whole
    loop, and what was visited is staged every few rounds, so the plan stays short.
    """
    present = inventory.select("ext_id", "path").distinct()
    links = (
        edges.filter((F.col("type") != "manifest") & ~F.col("dst").startswith("http"))
        .select("ext_id", F.col("src").alias("path"), F.col("dst")).distinct()
        .join(present.withColumnRenamed("path", "dst"), ["ext_id", "dst"], "left_semi")
    )
    links = cut_growing(links)
    start = edges.filter(F.col("type") == "manifest").select("ext_id", F.col("dst").alias("path")).distinct()
    frontier = cut_growing(start.join(present, ["ext_id", "path"], "left_semi"))
    visited = frontier
    rounds = 0
    while True:
        step = (
            links.join(frontier, ["ext_id", "path"], "left_semi")
            .select("ext_id", F.col("dst").alias("path")).distinct()
            .join(visited, ["ext_id", "path"], "left_anti")
        )
        frontier = cut_growing(step)
        if frontier.isEmpty():
            return visited
        visited, rounds = growing(visited.unionByName(frontier)), rounds + 1
        if rounds % 8 == 0:
            visited = cut_growing(visited)


def orphans(scripts: DataFrame, reached: DataFrame) -> DataFrame:
    return scripts.join(reached, ["ext_id", "path"], "left_anti")


def promoted_files(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(ext_id, path) of unknown files that are injected at run time."""
    targets = (
        edges.filter(F.col("type").isin("injected_file", "script_injection"))
        .select("ext_id", F.col("dst").alias("suffix")).distinct()
    )
    return (
        files.filter(F.col("role") == "unknown")
        .select("ext_id", "path", F.explode(suffixes(F.col("path"), "/")).alias("suffix"))
        .join(targets, ["ext_id", "suffix"], "left_semi")
        .select("ext_id", "path").distinct()
    )


def promote(rows: DataFrame, promoted: DataFrame) -> DataFrame:
    """Rows of promoted files become content scripts."""
    marked = rows.join(growing(promoted.withColumn("injected", F.lit(True))), ["ext_id", "path"], "left")
    return marked.withColumn("role", F.when(F.col("injected"), "content_script").otherwise(F.col("role"))).drop("injected")


def without_libraries(scripts: DataFrame, roles: DataFrame) -> DataFrame:
    """Script texts that are not libraries, without shuffling them.

    A path that does not look like a library never is one, so only library-looking scripts
    need their role, and of those only the few a manifest names otherwise stay.
    """
    looks = path_role(F.col("path")) == "library"
    named = roles.filter(looks & (F.col("role") != "library")).select("ext_id", "path")
    return scripts.filter(~looks).unionByName(scripts.filter(looks).join(named, ["ext_id", "path"], "left_semi"))
