"""Column expressions over names, paths, lines and layers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: layers in their order, names of trivial and infrastructure methods, words that mark layers
LAYERS = ("CONTROLLER", "SERVICE", "REPOSITORY", "HANDLER", "CONFIG", "CLIENT", "MODEL", "UTIL", "UNKNOWN")
TRIVIAL = (
    "toString", "hashCode", "equals", "getClass", "valueOf", "add", "size", "contains", "remove", "iterator", "toArray", "startPage", "getDataTable", "toAjax",
    "error", "success",
)
INFRASTRUCTURE = (
    "toString", "hashCode", "equals", "getClass", "valueOf", "add", "size", "contains", "remove", "iterator", "toArray", "put", "get", "stream", "collect",
    "forEach",
)
INFRASTRUCTURE_PREFIXES = ("System.", "Collections.", "Arrays.", "Objects.", "Logger.", "log.", "logger.")
TABLE_PARAMETERS = ("ByName", "ByTableName", "ByColumn")
CLASS_SUFFIXES = (
    ("CONTROLLER", "controller"), ("SERVICE", "serviceimpl|service"), ("REPOSITORY", "repository|dao|mapper"), ("HANDLER", "handler|listener|consumer"),
    ("CONFIG", "configuration|config"), ("CLIENT", "feignclient|client"), ("MODEL", "dto|vo|bo|entity|model"), ("UTIL", "utils|helper"),
)
PACKAGE_SEGMENTS = (
    ("CONTROLLER", ("controller", "api", "web")), ("SERVICE", ("service", "biz")), ("REPOSITORY", ("repository", "dao", "mapper")),
    ("HANDLER", ("handler", "listener", "consumer")), ("CONFIG", ("config", "configuration")), ("CLIENT", ("client", "feign")),
    ("MODEL", ("model", "entity", "dto", "vo")),
)
RISK_SCORES = {"CERTAIN": 1.0, "HIGH": 0.8, "MEDIUM": 0.5, "LOW": 0.2}
RISK_BASES = {"CERTAIN": "SOLID_ANALYSIS", "HIGH": "SOLID_ANALYSIS", "MEDIUM": "HEURISTIC", "LOW": "PARTIAL"}
PLAIN_DATA = "(DTO|VO|BO|ENTITY|MODEL)$"
WORDS_MOST = 550
_ACCESSOR = r"^(get|set|is)\p{Lu}"


def is_trivial_call(name: Column) -> Column:
    """Accessors of an upper-case property, and a fixed list."""
    return name.rlike(_ACCESSOR) | name.isin(*TRIVIAL)


def is_infrastructure_call(name: Column, callee: Column) -> Column:
    """Accessors, a wider list, and receivers by prefix."""
    prefixed = F.lit(False)
    for p in INFRASTRUCTURE_PREFIXES:
        prefixed = prefixed | callee.startswith(p)
    return name.rlike(_ACCESSOR) | name.isin(*INFRASTRUCTURE) | F.coalesce(prefixed, F.lit(False))


def is_table_parameter_method(name: Column) -> Column:
    """The name says that a table or column is a parameter."""
    return name.rlike("|".join(TABLE_PARAMETERS))


def class_of_path(path: Column) -> Column:
    """The class of a source path, from below the source root."""
    p = F.regexp_replace(path, r"\.java$", "")
    for root in ("src/main/java/", "src/test/java/"):
        p = F.when(p.contains(root), F.substring_index(p, root, -1)).otherwise(p)
    return F.regexp_replace(F.regexp_replace(p, "^src/", ""), "/", ".")


def simple_name(name: Column) -> Column:
    """Behind the last dot."""
    return F.substring_index(name, ".", -1)


def package_of(name: Column, default: str = "") -> Column:
    """Before the last dot; `default` without one."""
    return F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(default)


def top_packages(name: Column, n: int = 3) -> Column:
    """A4: the first n levels of a package."""
    return F.substring_index(name, ".", n)


def qualified(simple: Column, current: Column) -> Column:
    """A simple name in the current class's package; a dotted one stays."""
    return F.when(simple.contains(".") | ~current.contains("."), simple).otherwise(F.concat(package_of(current), F.lit("."), simple))


def layer_by_annotation(annotations: Column, name: Column) -> Column:
    """C4: by exact annotation names, in order of precedence."""
    has = lambda *xs: F.arrays_overlap(annotations, F.array(*[F.lit(x) for x in xs]))
    return (
        F.when(has("RestController", "Controller"), "CONTROLLER").when(has("Service"), "SERVICE").when(has("Repository"), "REPOSITORY")
        .when(has("Configuration", "ConfigurationProperties"), "CONFIG").when(has("Component") & name.rlike("Handler|Listener|Consumer"), "HANDLER")
    )


def layer_by_class(name: Column) -> Column:
    """By suffix, whatever the case, in order of precedence; `Util` only as the whole name."""
    low = F.lower(name)
    out = F.when(low == "util", "UTIL")
    first = None
    for layer, suffixes in CLASS_SUFFIXES:
        first = F.when(low.rlike(f"({suffixes})$"), layer) if first is None else first.when(low.rlike(f"({suffixes})$"), layer)
    return F.coalesce(first, out)


def layer_by_package(package: Column) -> Column:
    """By a whole segment of the package, in order of precedence."""
    dotted = F.concat(F.lit("."), package, F.lit("."))
    out = None
    for layer, segments in PACKAGE_SEGMENTS:
        hit = dotted.rlike(r"\.(" + "|".join(segments) + r")\.")
        out = F.when(hit, layer) if out is None else out.when(hit, layer)
    return out


def layer_of(name: Column, package: Column, annotations: Column | None = None) -> Column:
    """Annotation, else class name, else package, else UNKNOWN."""
    first = [layer_by_annotation(annotations, name)] if annotations is not None else []
    return F.coalesce(*first, layer_by_class(name), layer_by_package(package), F.lit("UNKNOWN"))


def layer_rank(layer: Column) -> Column:
    """The order of layers, for ties."""
    return F.array_position(F.array(*[F.lit(x) for x in LAYERS]), layer)


def stripped(text: Column) -> Column:
    """Without blanks, tabs and control characters at both ends."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def is_comment_or_blank(line: Column) -> Column:
    """P19."""
    t = stripped(line)
    return (t == "") | t.rlike(r"^(//|/\*|\*)")


def is_import_comment_or_blank(line: Column) -> Column:
    """The lines that P18 counts as of no significance."""
    return is_comment_or_blank(line) | stripped(line).startswith("import ")


def is_cross_object_call(target: Column) -> Column:
    """P20: what stands before the last dot is something other than this object; null is none."""
    before = F.regexp_replace(target, r"\.[^.]*$", "")
    return F.coalesce(target.contains(".") & (before != "this"), F.lit(False))


def normalised_method(target: Column) -> Column:
    """P20: the last segment, whatever it is; a name that ends in a dot stays, an empty one is null."""
    plain = F.regexp_replace(target, r"^this\.", "")
    return F.when(target != "", F.when(plain.rlike(r"\.[^.]+$"), F.substring_index(plain, ".", -1)).otherwise(plain))


def is_dto_like(name: Column) -> Column:
    """By suffix, whatever the case."""
    return F.coalesce(F.upper(name).rlike(PLAIN_DATA), F.lit(False))


def route(name: Column, kind: Column, loc: Column, methods: Column, has_default: Column | None = None) -> Column:
    """SINGLE for plain data, enums, interfaces without default methods and small classes, else MULTI."""
    small = (loc <= 300) & (methods <= 8) | (loc <= 800) & (methods <= 15)
    plain = (kind == "interface") & ~F.coalesce(has_default if has_default is not None else F.lit(False), F.lit(False))
    return F.when(is_dto_like(name) | (kind == "enum") | plain | small, "SINGLE").otherwise("MULTI")


def should_verify(level: Column, threshold: str) -> Column:
    """Levels from CERTAIN to UNKNOWN; at or above the threshold."""
    levels = F.array(*[F.lit(x) for x in ("CERTAIN", "HIGH", "MEDIUM", "LOW", "UNKNOWN")])
    return F.array_position(levels, level).between(1, ("CERTAIN", "HIGH", "MEDIUM", "LOW", "UNKNOWN").index(threshold) + 1)


def score_of(confidence: Column) -> Column:
    """C13."""
    out = F.when(confidence == "CERTAIN", 1.0)
    for level, score in list(RISK_SCORES.items())[1:]:
        out = out.when(confidence == level, score)
    return out.otherwise(0.0)


def basis_of(confidence: Column) -> Column:
    """What a confidence rests on."""
    out = F.when(confidence == "CERTAIN", RISK_BASES["CERTAIN"])
    for level, basis in list(RISK_BASES.items())[1:]:
        out = out.when(confidence == level, basis)
    return out.otherwise("UNKNOWN")


def dependency_name(name: Column) -> Column:
    """Without a call and its method name, package and interface mark, first letter in lower case."""
    called = F.regexp_replace(F.regexp_replace(name, r"(?s)\(.*$", ""), r"\.[^.]*$", "")
    plain = F.substring_index(F.when(name.contains("("), called).otherwise(name), ".", -1)
    plain = F.regexp_replace(plain, r"^I(?=\p{Lu})", "")
    return F.concat(F.lower(F.substring(plain, 1, 1)), F.substring(plain, 2, 1 << 20))


def one_of(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    """An allowed value, else the default."""
    return F.when(value.isin(*allowed), value).otherwise(default)


def name_in_line(name: Column, line: Column) -> Column:
    """The whole name, its last two segments, or its last segment as a word."""
    last_two, last = F.substring_index(name, ".", -2), F.substring_index(name, ".", -1)
    word = F.concat(F.lit(r"(^|[^A-Za-z0-9_])\Q"), last, F.lit(r"\E([^A-Za-z0-9_]|$)"))
    return line.contains(name) | line.contains(last_two) | F.regexp_like(line, word)


def line_of_name(name: Column, lines: Column) -> Column:
    """The number of the first line that has the name, else 0. lines: an array."""
    return F.coalesce(F.array_position(F.transform(lines, lambda x: F.coalesce(name_in_line(name, x), F.lit(False))), F.lit(True)), F.lit(0)).cast("int")


def json_escaped(text: Column) -> Column:
    """The text as the inside of a JSON string; null is the empty one. Line feed, carriage return and tab have names, other control characters go by number."""
    out = F.coalesce(text, F.lit(""))
    named = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    for c, escape in [*named.items(), *((chr(n), f"\\u{n:04x}") for n in range(32) if chr(n) not in "\n\r\t")]:
        out = F.replace(out, F.lit(c), F.lit(escape))
    return out


def project_root(path: Column, marked: Column, built: Column) -> Column:
    """Of the folders above a file, the nearest that is marked, else the nearest that has a build file, else null.

    marked and built: arrays of folders that hold the mark of an analysed project, and a build file.
    """
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    above = F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))
    nearest = lambda folders: F.get(F.filter(above, lambda p: F.array_contains(folders, p)), F.lit(0))
    return F.coalesce(nearest(marked), nearest(built))


def source_root(path: Column) -> Column:
    """The path up to the folder of main or test sources, else its own folder."""
    root = F.regexp_extract(path, r"^(.*?src/(?:main|test)/java)/", 1)
    return F.when(root != "", root).otherwise(F.regexp_replace(path, r"/?[^/]*$", ""))


def too_many_words(text: Column) -> Column:
    """More than WORDS_MOST words between white space."""
    return F.coalesce(F.size(F.split(stripped(text), r"\s+")) > WORDS_MOST, F.lit(False))


def effective_temperature(locked: Column, preset: Column, wanted: Column) -> Column:
    """C20: a locked preset's own value, else what is wanted, else the preset's."""
    return F.when(F.coalesce(locked, F.lit(False)), preset).otherwise(F.coalesce(wanted, preset))


def profile_key(provider: Column, model: Column) -> Column:
    """The key of a model's profile."""
    return F.concat(F.lower(F.coalesce(provider, F.lit(""))), F.lit(":"), F.lower(F.coalesce(model, F.lit(""))))


def profile_of(provider: Column, model: Column, profiles: Column, fallback: Column) -> Column:
    """The profile under the key, or the fallback. profiles: a map."""
    return F.coalesce(F.try_element_at(profiles, profile_key(provider, model)), fallback)


def shortened(text: Column, n: int, mark: str = "...") -> Column:
    """C14: at most n characters and a mark."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def sql_shortened(text: Column) -> Column:
    """C14, of SQL texts: 200 characters in all."""
    return F.when(F.length(text) > 200, F.concat(F.substring(text, 1, 197), F.lit("..."))).otherwise(text)


def has_field(csv: Column, field: str) -> Column:
    """C17: in the trimmed list; a null list has every field."""
    return csv.isNull() | F.array_contains(F.transform(F.split(csv, ","), lambda x: F.trim(x)), field)


def token_estimate(text: Column) -> Column:
    """Characters by 1.5, rounded up."""
    return F.ceil(F.length(text) / 1.5)


def impact_confidence(call_type: Column, hop: Column) -> Column:
    """G3."""
    base = F.when(call_type == "DIRECT", "HIGH").when(call_type == "REFLECTION", "LOW").otherwise("MEDIUM")
    return F.when((hop >= 2) & (base == "HIGH"), "MEDIUM").otherwise(base)


def risk_score(hop: Column, confidence: Column, max_hops: int = 3) -> Column:
    """3 for certain direct impact down to 0 beyond the hops."""
    direct = F.when(confidence == "HIGH", 3).when(confidence == "MEDIUM", 2)
    near = F.when(hop <= max_hops, 1).otherwise(0)
    return F.coalesce(F.when(hop == 1, direct), F.when((hop == 2) & (confidence == "HIGH"), 2), near)


def path_text(path: Column) -> Column:
    """C22."""
    return F.array_join(path, " → ")
