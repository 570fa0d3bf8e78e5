"""Names and paths of source files: groups, domains, roles, tokens, relations between paths. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import ascii_lower, bind, identifier

#: Part of a path and the feature group it stands for, the first that holds (fixed values).
FEATURES = (
    ("src/app/store/", "app/store"), ("src/app/selection", "app/selection"), ("src/app/", "app"), ("src/main-window/", "main-window"),
    ("src/window-bus/", "window-bus"), ("src/startup/", "startup"), ("src/features/assets/", "feature/assets"), ("src/features/cache/", "feature/cache"),
    ("src/features/diagnostics/", "feature/diagnostics"), ("src/features/events/", "feature/events"), ("src/features/project/", "feature/project"),
    ("src/features/files/", "feature/files"), ("src/features/inspector/", "feature/inspector"), ("src/features/scenes/", "feature/scenes"),
    ("src/features/scripting/", "feature/scripting"), ("src/features/tasks/", "feature/tasks"), ("src/properties/", "properties"),
    ("src/settings/", "settings"), ("src/components/", "shared/components"), ("src/editor-components/", "editor-components"), ("src-tauri/", "tauri"),
)
#: The application whose folders the domains below name; the tool's own folder. Both are parameters of a repository.
APP, TOOL = "crates/apps/editor/", "crates/tools/index/"
#: Prefix of a path, its domain and its layer, the first that holds (fixed values).
DOMAINS = (
    (TOOL, "index", "tool"), (APP + "src/editors/ui-document/", "ui-document", "app"), (APP + "src/features/scenes/editor/", "scene-editor", "app"),
    (APP + "src-tauri/src/editor_mode/", "editor-mode", "app-backend"), (APP + "src-tauri/", "editor-backend", "app-backend"), (APP + "src/api/", "editor-api", "app"),
    (APP + "src/main-window/", "workspace", "app"), (APP + "src/dock/", "workspace", "app"), (APP + "src/properties/", "properties", "app"),
    (APP + "src/features/inspector/", "properties", "app"), (APP + "src/features/project/", "project", "app"), (APP + "src/features/assets/", "assets", "app"),
    (APP + "src/assets/", "assets", "app"), (APP + "src/ui/context-dock/", "context-dock", "app"), ("crates/apps/app/", "runtime-app", "runtime-app"),
    ("crates/engine/scene/", "engine-scene", "engine"), ("crates/ui/core/", "ui-core", "engine"), ("crates/scripting/", "scripting", "scripting"),
    ("mods/playground-", "playground", "mod"), ("mods/", "mod", "mod"), ("docs/", "docs", "docs"),
)
#: End of a path and the role of the file, the first that holds (fixed values).
ROLES = (
    (".css", "style"), (".scss", "style"), ("scene.yml", "scene-yaml"), ("scene.yaml", "scene-yaml"), (".rhai", "scene-script"),
    ("mod.toml", "mod-manifest"), ("manifest.toml", "mod-manifest"), (".md", "docs"),
)
#: Classes of paths: (class, parts, ends); a path is of every class of which it has a part or an end (fixed values).
CLASSES = (
    ("test", ("/tests/",), ("_test.rs", ".test.ts", ".test.tsx", ".spec.ts", ".spec.tsx")), ("generated", ("/gen/", ".generated."), ("-schema.json",)),
    ("catalog", ("descriptor", "registry"), ("dto.rs", "dto.ts", "-schema.json")), ("stylesheet", (), (".css", ".scss", ".sass", ".less")),
    ("docs", ("/docs/",), (".md", ".txt")), ("unranked", (), ("Cargo.lock", "package-lock.json", ".png", ".jpg", ".webp")),
)
#: Parts of a command's name and its group, the first group that holds (fixed values).
COMMANDS = (
    ("windows", ("window",)), ("session", ("session",)), ("project_tree", ("scene_document", "tree", "hierarchy", "structure")),
    ("project_files", ("expected_project_folder", "project_file", "read_project", "write_project")), ("mods", ("mod", "validate")), ("assets", ("asset",)),
    ("sheets", ("sheet", "tile")), ("preview", ("preview",)), ("cache", ("cache",)), ("settings", ("setting", "theme", "font")),
)
SESSION_NAMES = ("open_mod", "open_mod_workspace")


def first_of(rules, otherwise: Column) -> Column:
    return F.coalesce(*[F.when(rule, F.lit(name)) for rule, name in rules], otherwise)


def group_path(path: Column) -> Column:
    """The first folder; of crates the first two, of applications and tools the first three."""
    parts = F.split(path, "/")
    deep = F.when(F.get(parts, F.lit(1)).isin("apps", "tools"), 3).otherwise(2)
    crate = (F.get(parts, F.lit(0)) == "crates") & (F.size(parts) >= 3)
    return F.array_join(F.slice(parts, F.lit(1), F.when(crate, deep).otherwise(1)), "/")


def feature_group(path: Column, app: str = APP) -> Column:
    rest = F.substring(path, len(app + "src/") + 1, 1 << 20)
    inner = F.when(path.startswith(app + "src/"), F.substring_index(rest, "/", 1)).otherwise(group_path(path))
    return first_of([(F.contains(path, F.lit(part)), name) for part, name in FEATURES], inner)


def domain_and_layer(path: Column) -> tuple[Column, Column]:
    known = [(path.startswith(p), d, la) for p, d, la in DOMAINS] + [(path.endswith(".md"), "docs", "docs")]
    return first_of([(rule, d) for rule, d, _ in known], F.lit("index")), first_of([(rule, la) for rule, _, la in known], F.lit("tool"))


def role_of(path: Column) -> Column:
    return first_of([(path.endswith(end), role) for end, role in ROLES], F.lit("file"))


def language_of(path: Column) -> Column:
    """The extension in lower case; two manifests by name; ``txt`` without an extension."""
    name = ascii_lower(F.substring_index(path, "/", -1))
    extension = F.regexp_extract(name, r"[^.]\.([^.]+)$", 1)
    return F.when(name == "cargo.toml", "cargo").when(name == "package.json", "package").when(extension == "", "txt").otherwise(extension)


def classes_of(path: Column) -> Column:
    """Every class of a path, in order."""
    holds = lambda parts, ends: F.greatest(F.lit(False), F.lit(False), *[F.contains(path, F.lit(p)) for p in parts], *[path.endswith(e) for e in ends])
    return F.array_compact(F.array(*[F.when(holds(parts, ends), F.lit(name)) for name, parts, ends in CLASSES]))


def command_group(name: Column) -> Column:
    def holds(group: str, parts) -> Column:
        found = F.greatest(F.lit(False), *[F.contains(name, F.lit(p)) for p in parts])
        return found | name.isin(*SESSION_NAMES) if group == "session" else found

    return first_of([(holds(group, parts), group) for group, parts in COMMANDS], F.lit("shared"))


def command_target(group: Column) -> Column:
    return F.concat(F.lit("commands/"), group, F.lit(".rs"))


def trace_kind(query: Column) -> Column:
    has = lambda x: F.contains(query, F.lit(x))
    rules = [(query.startswith("."), "css-class"), (has("/") & has("scene"), "scene-path"), (has(".") & has("-"), "id-like-string"), (query.endswith("_command") | has("invoke"), "command")]
    return first_of(rules, F.lit("symbol-or-text"))


def name_tokens(name: Column) -> Column:
    """The words of a name in lower case: cut at other characters, at camel case and between letters and digits."""
    for pattern in (r"([a-z])([A-Z])", r"([A-Za-z])([0-9])", r"([0-9])([A-Za-z])", r"([A-Z])([A-Z][a-z])"):
        name = F.regexp_replace(name, pattern, "$1 $2")
    return F.filter(F.split(ascii_lower(name), "[^a-z0-9]+"), lambda x: x != "")


def symbol_similarity(name: Column, query: str) -> Column:
    """Likeness of a name to a query: prefix 50, common prefix and shared characters 20 each at most, 10 for each shared token."""
    bare, bare_query = identifier(name), "".join(c for c in query.lower() if c.isascii() and c.isalnum())
    prefix = F.when(bare.startswith(bare_query) | F.lit(bare_query).startswith(bare), 50).otherwise(0)
    common = sum((ascii_lower(name).startswith(query[:k].lower()).cast("int") for k in range(1, min(len(query), 20) + 1)), F.lit(0))
    chars = F.least(F.length(F.regexp_replace(bare, f"[^{''.join(sorted(set(bare_query)))}]", "")), F.lit(20)) if bare_query else F.lit(0)
    tokens = sorted({x for x in "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in query).split()})
    shared = F.size(F.array_intersect(F.array_distinct(F.split(ascii_lower(name), "[^a-z0-9]+")), F.array(*map(F.lit, tokens)).cast("array<string>")))
    return prefix + common + chars + 10 * shared


def symbol_score(name: Column, query: str) -> Column:
    """1000 for the name itself, 900 without case and signs, else the similarity."""
    bare_query = "".join(c for c in query.lower() if c.isascii() and c.isalnum())
    return F.when(name == query, 1000).when(identifier(name) == bare_query, 900).otherwise(symbol_similarity(name, query))


def shared_prefix(a: Column, b: Column) -> Column:
    """Characters that two names begin with alike."""
    alike = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(alike, False)
    return F.when((a == "") | (b == ""), 0).when(first == 0, F.size(alike)).otherwise(first - 1).cast("bigint")


def lexical(path: Column) -> Column:
    """A path without ``.``; each ``..`` takes the folder before it away."""
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def relative_module(source: Column, target: Column) -> Column:
    """The specifier by which the file ``source`` names the module ``target``; null if that is a folder above it."""
    folder = F.split(source, "/")
    folder = F.slice(folder, F.lit(1), F.size(folder) - 1)
    parts = F.split(target, "/")
    parts = F.when(F.element_at(parts, -1).isin("index.ts", "index.tsx"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    # the folders that both share, counted; each step is worked out once for a pair
    alike = lambda x: F.zip_with(x["folder"], x["parts"], lambda a, b: F.coalesce(a == b, F.lit(False)))
    shared = lambda x: (F.array_position(F.concat(alike(x), F.array(F.lit(False))), False) - 1).cast("int")

    def named(x: Column, k: Column) -> Column:
        up, down = F.size(x["folder"]) - k, F.slice(x["parts"], k + 1, F.size(x["parts"]))
        path = F.concat(F.repeat(F.lit("../"), up), F.array_join(down, "/"))
        bare = F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"(\.tsx?)+$", "")
        name = bind(bare, lambda p: F.when(p.startswith("."), p).otherwise(F.concat(F.lit("./"), p)))
        rest = F.size(x["parts"]) - k
        return F.when((up == 0) & (rest == 0), "./").when(rest > 0, name)

    return bind(F.struct(folder.alias("folder"), parts.alias("parts")), lambda x: bind(shared(x), lambda k: named(x, k)))


def module_base(source: Column, specifier: Column) -> Column:
    """The path that a relative specifier of the file ``source`` leads to, as it stands."""
    return lexical(F.concat(F.regexp_replace(source, r"[^/]*$", ""), specifier))


def candidates(base: Column) -> Column:
    """Files that a path in place of a module may mean, in order of preference."""
    stem = F.regexp_replace(base, r"\.[^./]*$", "")
    return F.array(base, F.concat(stem, F.lit(".ts")), F.concat(stem, F.lit(".tsx")), F.concat(base, F.lit("/index.ts")), F.concat(base, F.lit("/index.tsx")))


def module_candidates(source: Column, specifier: Column) -> Column:
    """Files that a relative specifier may mean, in order of preference; none for other specifiers."""
    return F.when(specifier.startswith("."), bind(module_base(source, specifier), candidates)).otherwise(F.array().cast("array<string>"))
