"""Facts of Java source: types and what they extend, fields, methods, parameters, locals and calls, and what calls resolve to.

A file is read once, token by token, with a stack of open braces: comments, strings and text blocks are skipped as tokens, generics,
annotation arguments, lambdas, array initialisers, anonymous, local and several top-level types each open a frame of their own.
Every declaration comes with the part of the file where its name holds, so that what a call's receiver is follows from a
sweep over intervals. A file that is no Java gives what is found in it. Work is linear in the text.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.columns import is_infrastructure_call, is_trivial_call, package_of
from factlake.operators.intervals import innermost
from factlake.session import checkpointed

_TOKEN = re.compile(
    r'''//[^\n]*|/\*.*?(?:\*/|\Z)|"""(?:\\.|[^\\])*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|[\w$]+|->|::|[^\s\w]''', re.S
)
_TYPES = frozenset("class interface enum record".split())
_MODIFIERS = frozenset("public private protected static final abstract synchronized native default transient volatile strictfp sealed".split())
_KEYWORDS = frozenset("if for while switch catch return new synchronized try else do throw super this assert case instanceof yield when".split())
#: words after which a name and a parenthesis are a call, not a declaration
_BEFORE_CALL = frozenset("return throw else case assert do yield in".split())
INJECTED = ("Autowired", "Resource", "Inject")
#: begin and end are offsets of the part of the file where a declared name holds, and of a call; root is the first name of a call's chain
FACTS = "path string, kind string, class_name string, name string, type string, annotations array<string>, visibility string, begin_line int, end_line int, begin long, end long, root string, method string"


def _name(token: str) -> bool:
    return token[0].isalpha() or token[0] in "_$"


class _Frame:
    """An open brace: type, method, block or values; the tokens since its last statement, and the names declared in it."""

    __slots__ = ("kind", "owner", "simple", "head", "at", "parens", "locals", "emit", "enum", "arrows")

    def __init__(self, kind: str, owner: str, simple: str = "", at: int = 0, emit: tuple | None = None, enum: bool = False) -> None:
        self.kind, self.owner, self.simple, self.at, self.emit, self.enum = kind, owner, simple, at, emit, enum
        self.head: list[tuple[str, int]] = []
        self.parens, self.locals, self.arrows = 0, [], []  # arrows: parameters of open lambdas, with the parentheses around them


def _skip(head: list, i: int, opening: str, closing: str) -> int:
    """The place behind the bracket that closes the one at i."""
    depth = 0
    while i < len(head):
        depth += (head[i][0] == opening) - (head[i][0] == closing)
        i += 1
        if not depth:
            break
    return i


def _lead(head: list) -> tuple[int, list[str], str]:
    """Where a declaration begins behind annotations, modifiers and type parameters; its annotations and visibility."""
    i, notes, visible = 0, [], ""
    while i < len(head):
        t = head[i][0]
        if t == "@" and i + 1 < len(head) and head[i + 1][0] != "interface":
            i += 1
            while i + 2 < len(head) and head[i + 1][0] == ".":
                i += 2
            notes.append(head[i][0])
            i += 1
            if i < len(head) and head[i][0] == "(":
                i = _skip(head, i, "(", ")")
        elif t in _MODIFIERS or t == "non" or t == "-":
            visible = t if t in ("public", "private", "protected") else visible
            i += 1
        elif t == "<":
            i = _skip(head, i, "<", ">")
        else:
            break
    return i, notes, visible


def _type(head: list, i: int) -> tuple[str, int]:
    """A type without its generics, and the place behind it; empty if there is none."""
    if i >= len(head) or not _name(head[i][0]) or head[i][0] in _KEYWORDS:
        return "", i
    text = head[i][0]
    i += 1
    while i < len(head):
        t = head[i][0]
        if t == "." and i + 1 < len(head) and _name(head[i + 1][0]):
            text, i = f"{text}.{head[i + 1][0]}", i + 2
        elif t == "<":
            i = _skip(head, i, "<", ">")
        elif t == "[" and i + 1 < len(head) and head[i + 1][0] == "]":
            text, i = text + "[]", i + 2
        elif t == "@" and i + 1 < len(head):
            i += 2
        else:
            break
    return text, i


def _names(head: list, i: int) -> Iterator[tuple[str, int]]:
    """Names declared from i on, which commas part; what they are set to is skipped."""
    while i < len(head) and _name(head[i][0]):
        yield head[i]
        i += 1
        while i < len(head) and head[i][0] != ",":
            t = head[i][0]
            i = _skip(head, i, t, {"(": ")", "[": "]"}[t]) if t in "([" else i + 1
        i += 1


def _parameters(head: list, i: int, end: int) -> Iterator[tuple[str, str]]:
    """Type and name of what is declared between parentheses: parameters, resources, caught exceptions, loop variables."""
    while i < end:
        skipped, _, _ = _lead(head[i:end])
        kind, j = _type(head, i + skipped)
        while j < end and head[j][0] in ("|", "."):  # other caught types, or varargs
            j = j + 1 if head[j][0] == "." else _type(head, j + 1)[1]
        if kind and j < end and _name(head[j][0]) and head[j][0] != "instanceof":
            yield kind, head[j][0]
        elif kind and j == i + skipped + 1 and (j >= end or head[j][0] == ","):
            yield "", kind  # a lambda's parameter without a type
        while j < end and head[j][0] not in ",;":
            t = head[j][0]
            j = _skip(head, j, "(", ")") if t == "(" else j + 1
        i = j + 1


def facts(path: str, content: str) -> Iterator[tuple]:
    """Rows of FACTS: kinds package, import (type static, if it is), class, interface, enum, record, super (type: extends or
    implements), field, method, constructor, param, local and call (type: its scope, method: the method it is in)."""
    newlines = [m.start() for m in re.finditer("\n", content)]
    line = lambda at: bisect.bisect_left(newlines, at) + 1
    row = lambda kind, owner, name, type_="", notes=(), visible="", a=0, b=0, begin=0, end=0, root="", method="": (path, kind, owner, name, type_, list(notes), visible, line(a), line(b), begin, end, root, method)
    package, length = "", len(content)
    stack = [_Frame("top", "")]
    brackets: list[str] = []  # of each open parenthesis, the root of the call that it belongs to
    callers: list[str] = [""]
    before, last, closed = "", "", ""  # the two tokens before, and the root of the call that was closed last
    chain: list[str] = []
    chain_before, root = "", ""

    def declared(frame: _Frame, head: list, a: int) -> Iterator[tuple]:
        """Fields and locals of a statement."""
        i, notes, visible = _lead(head)
        kind, j = _type(head, i)
        if not kind or j >= len(head) or not _name(head[j][0]) or head[j][0] in _KEYWORDS:
            return
        if j + 1 < len(head) and head[j + 1][0] not in ("=", ",", "[", ":"):
            return
        if kind == "var":
            new = next((k for k in range(j, len(head) - 1) if head[k][0] == "new"), None)
            kind = _type(head, new + 1)[0] if new == j + 2 else ""
        for name, at in _names(head, j):
            if frame.kind == "type":
                yield row("field", frame.owner, name, kind, notes, visible, head[0][1], a, frame.at, -1)
            else:
                frame.locals.append((name, kind, at))

    def ended(frame: _Frame, at: int, parens: int = -1) -> Iterator[tuple]:
        """The parameters of lambdas that lie deeper than so many parentheses."""
        while frame.arrows and frame.arrows[-1][3] > parens:
            name, kind, begin, _ = frame.arrows.pop()
            yield row("local", frame.owner, name, kind, a=begin, b=at, begin=begin, end=at)

    def opened(frame: _Frame, at: int) -> Iterator[tuple]:
        """Push the frame of a brace."""
        head = frame.head
        i, notes, visible = _lead(head)
        begin = head[0][1] if head else at
        word = head[i][0] if i < len(head) else ""
        annotation = word == "@" and i + 2 < len(head)
        if not frame.parens and (annotation or word in _TYPES) and i + 1 < len(head) and _name(head[i + 1 + annotation][0]):
            kind, simple = ("interface" if annotation else word), head[i + 1 + annotation][0]
            owner = f"{frame.owner}.{simple}" if frame.owner else f"{package}.{simple}" if package else simple
            j, supers, mode, fields = i + 2 + annotation, [], "", []
            while j < len(head):
                t = head[j][0]
                if t == "<":
                    j = _skip(head, j, "<", ">")
                elif t == "(":
                    end = _skip(head, j, "(", ")")
                    fields, j = list(_parameters(head, j + 1, end - 1)), end
                elif t in ("extends", "implements", "permits"):
                    mode, j = t, j + 1
                elif mode in ("extends", "implements") and _name(t):
                    name, j = _type(head, j)
                    supers.append((name, mode))
                else:
                    j += 1
            parent = supers[0][0] if supers and supers[0][1] == "extends" and kind == "class" else ""
            yield row(kind, owner, owner, parent, notes, "public" if visible == "public" else "", begin, begin, at)
            for name, mode in supers:
                yield row("super", owner, name, mode, a=begin, b=begin)
            for type_, name in fields:
                yield row("field", owner, name, type_, (), "private", begin, begin, at, -1)
            new = _Frame("type", owner, simple, at, enum=kind == "enum")
        elif frame.kind == "type" and not frame.parens and (m := _method(frame, head, i)):
            constructor, name, kind, params = m
            new = _Frame("method", frame.owner, "", at, ("constructor" if constructor else "method", name, kind, notes, visible, begin))
            new.locals = [(n, t, begin) for t, n in params]
            callers.append("" if constructor else name)
        elif last == ")" and _anonymous(head) or frame.kind == "type" and frame.enum and head and not frame.parens:
            new = _Frame("type", frame.owner, "", at)  # an anonymous class: its methods belong to the type around it
        elif last in ("=", "]", ",", "{") or frame.kind == "values" or last == "(":
            new = _Frame("values", frame.owner, "", at)
        else:
            new = _Frame("block", frame.owner, "", at)
            if head and head[0][0] in ("for", "catch", "try", "while", "if") and len(head) > 1 and head[1][0] == "(":
                new.locals = [(n, t, at) for t, n in _parameters(head, 2, _skip(head, 1, "(", ")") - 1) if t]
        stack.append(new)

    for match in _TOKEN.finditer(content):
        token, at = match[0], match.start()
        if token.startswith(("//", "/*")):
            continue
        if token[0] in "\"'":
            token = '""'
        frame = stack[-1]
        if _name(token):
            if last == ".":
                if before and _name(before):
                    chain.append(token)
                else:
                    chain, chain_before, root = [token], ".", closed if before == ")" else ""
            else:
                chain, chain_before, root = [token], last, token
        elif token == "(":
            own = ""
            if last and _name(last):
                own = root
                call = last not in _KEYWORDS and chain_before not in ("new", "@", "instanceof")
                # a name and a parenthesis behind a type declare something
                declares = len(chain) == 1 and (chain_before in (">", "]") or chain_before and _name(chain_before) and chain_before not in _BEFORE_CALL)
                if frame.kind == "type" and not frame.parens and all(t != "=" for t, _ in frame.head[-200:]):
                    declares = True
                if call and not declares and frame.kind != "top":
                    plain = chain_before != "."
                    yield row("call", frame.owner, last, ".".join(chain[:-1]) if plain else "", a=at, b=at, begin=at, end=at, root="" if plain and len(chain) == 1 else root or "?", method=callers[-1])
            brackets.append(own)
            frame.parens += 1
        elif token == ")":
            closed = brackets.pop() if brackets else ""
            frame.parens = max(0, frame.parens - 1)
        if frame.arrows and (token in ");" or token == "," and frame.arrows[-1][3] == frame.parens):
            yield from ended(frame, at, frame.parens - (token == ","))
        elif token == "->" and not (frame.head and frame.head[0][0] in ("case", "default")):
            frame.arrows += [(n, t, at, frame.parens) for t, n in _lambda(frame.head)]
        if token == "{":
            yield from opened(frame, at)
        elif token == "}":
            yield from ended(frame, at)
            if len(stack) > 1:
                stack.pop()
                for name, kind, begin in frame.locals:
                    yield row("param" if frame.kind == "method" and begin == frame.emit[5] else "local", frame.owner, name, kind, a=begin, b=at, begin=begin, end=at)
                if frame.kind == "method":
                    callers.pop()
                    what, name, kind, notes, visible, begin = frame.emit
                    yield row(what, frame.owner, name, kind, notes, visible, begin, at, begin, at)
                if frame.kind == "type":
                    yield row("body", frame.owner, frame.simple, "", a=frame.at, b=at, begin=frame.at, end=at)
                frame = stack[-1]
                # behind a body that is a part of an expression the statement goes on
                if not frame.parens and not (stack and _goes_on(frame.head)):
                    frame.head = []
        elif token == ";" and not frame.parens:
            head = frame.head
            if frame.kind == "top" and head and head[0][0] in ("package", "import"):
                static = len(head) > 1 and head[1][0] == "static"
                name = "".join(t for t, _ in head[1 + static :])
                if head[0][0] == "package":
                    package = name
                yield row(head[0][0], "", name, "static" if static else "", a=head[0][1], b=head[0][1])
            elif frame.kind == "type" and head and (m := _method(frame, head, _lead(head)[0])):
                _, notes, visible = _lead(head)
                if not m[0]:
                    yield row("method", frame.owner, m[1], m[2], notes, visible, head[0][1], at, head[0][1], at)
            elif frame.kind in ("type", "method", "block") and not (frame.kind == "type" and frame.enum):
                yield from declared(frame, head, at)
            yield from ended(frame, at)
            frame.enum = False  # behind its constants an enum is like a class
            frame.head = []
        elif token in (":", "->") and not frame.parens and frame.head and frame.head[0][0] in ("case", "default"):
            frame.head = []
        elif frame.kind != "values":
            frame.head.append((token, at))
        before, last = last, token
    for frame in reversed(stack[1:]):  # a file that ends early
        for name, kind, begin in frame.locals:
            yield row("local", frame.owner, name, kind, a=begin, b=length, begin=begin, end=length)
        if frame.kind == "type":
            yield row("body", frame.owner, frame.simple, "", a=frame.at, b=length, begin=frame.at, end=length)


def _method(frame: _Frame, head: list, i: int) -> tuple | None:
    """(constructor, name, type, parameters) of a method's head."""
    kind, j = _type(head, i)
    if not kind:
        return None
    if j < len(head) and _name(head[j][0]) and head[j][0] not in _KEYWORDS and j + 1 < len(head) and head[j + 1][0] == "(":
        end = _skip(head, j + 1, "(", ")")
        return False, head[j][0], kind, list(_parameters(head, j + 2, end - 1))
    if frame.simple and kind == frame.simple and (j == len(head) or head[j][0] == "("):
        end = _skip(head, j, "(", ")")
        return True, kind, "", list(_parameters(head, j + 1, end - 1))
    return None


def _back(head: list) -> int:
    """How many tokens the parentheses at the end take."""
    depth = 0
    for n, (t, _) in enumerate(reversed(head), 1):
        depth += (t == ")") - (t == "(")
        if not depth:
            return n
    return len(head)


def _anonymous(head: list) -> bool:
    """The parentheses at the end belong to a new object."""
    i = len(head) - _back(head) - 1
    depth = 0
    while i >= 0:
        t = head[i][0]
        depth += (t == ">") - (t == "<")
        if not depth and t not in ("<", ".") and not _name(t):
            return False
        if not depth and t == "new":
            return True
        i -= 1
    return False


def _lambda(head: list) -> Iterator[tuple[str, str]]:
    """The parameters before an arrow."""
    if head and head[-1][0] == ")":
        yield from _parameters(head, len(head) - _back(head) + 1, len(head) - 1)
    elif head and _name(head[-1][0]):
        yield "", head[-1][0]


def _goes_on(head: list) -> bool:
    """A body that has closed was a value of the statement: behind =, return, new or an arrow."""
    i, _, _ = _lead(head)
    if i < len(head) and head[i][0] in ("return", "throw", "yield"):
        return True
    depth = 0
    for t, _ in head:
        depth += (t == "(") - (t == ")")
        if t == "=" and not depth:
            return True
    return bool(head) and (head[-1][0] == "->" and head[0][0] not in ("case", "default")) or bool(head) and head[0][0] == "new"


def java_facts(files: DataFrame) -> DataFrame:
    """Facts of every file (path, content); a generator over Arrow batches, no shuffle."""
    names = [f.split(" ")[0] for f in FACTS.split(", ")]
    kinds = [pa.string()] * 5 + [pa.list_(pa.string()), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in facts(p, c or "")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], names=names)

    return files.select("path", "content").mapInArrow(scan, FACTS)


def code_terms(found: DataFrame) -> DataFrame:
    """Terms of types, annotations, methods and calls; trivial names left out."""
    types = found.filter(F.col("kind").isin("class", "interface", "enum", "record"))
    row = lambda df, term, kind: df.select(term.alias("term"), F.lit(kind).alias("term_type"), F.col("path").alias("file_path"), F.col("begin_line").alias("line_number"))
    calls = found.filter("kind = 'call'").filter(~is_trivial_call(F.col("name")))
    scoped = F.array_compact(F.array(F.when(F.col("type") != "", F.concat_ws(".", "type", "name")), F.col("name")))
    parts = [
        row(types, F.substring_index("name", ".", -1), "CLASS"), row(types.withColumn("a", F.explode("annotations")), F.col("a"), "ANNOTATION"),
        row(found.filter("kind = 'method'").filter(~is_trivial_call(F.col("name"))), F.col("name"), "METHOD"), row(calls.withColumn("t", F.explode(scoped)), F.col("t"), "CALLEE"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def enclosing_methods(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """Each call with the innermost method whose lines hold its line, or none. calls: path, line; methods: path, name, begin_line, end_line, class_name."""
    names = methods.select("path", "begin_line", "end_line", F.col("name").alias("method"), "class_name")
    out = innermost(calls, names, ["path"], "line", "begin_line", "end_line", ["method", "class_name"])
    return out.select(*calls.columns, F.coalesce("found_method", F.lit("")).alias("caller_method"), F.col("found_class_name").alias("caller_class"))


def _known(found: DataFrame) -> DataFrame:
    """The types that the sources declare."""
    return found.filter(F.col("kind").isin("class", "interface", "enum", "record")).select(F.col("name").alias("fqn")).distinct()


def resolved(rows: DataFrame, simple: str, found: DataFrame, out: str) -> DataFrame:
    """rows (path, package and a type as written) with its full name: as imported; else nested in a type of the file, or of the own package if it is declared there;
    else of the one package imported as a whole that declares it; else as if of the own package, or as written if it has dots."""
    imports = found.filter("kind = 'import' and type = '' and not endswith(name, '*')")
    exact = imports.groupBy(F.col("path").alias("_p"), F.substring_index("name", ".", -1).alias("_s")).agg(F.min("name").alias("_import"))
    nested = found.filter(F.col("kind").isin("class", "interface", "enum", "record")).groupBy(F.col("path").alias("_p"), F.substring_index("name", ".", -1).alias("_s")).agg(F.min("name").alias("_nested"))
    wide = found.filter("kind = 'import' and type = '' and endswith(name, '*')").select(F.col("path").alias("_p"), F.expr("substring(name, 1, length(name) - 2)").alias("_pkg"))
    declared = _known(found).select(package_of(F.col("fqn")).alias("_pkg"), F.substring_index("fqn", ".", -1).alias("_s"), F.col("fqn").alias("_fqn"))
    wide = wide.join(declared, "_pkg").groupBy("_p", "_s").agg(F.min("_fqn").alias("_wide"))
    own = declared.select(F.col("_pkg").alias("_q"), "_s", F.col("_fqn").alias("_own")).distinct()
    first = F.substring_index(F.regexp_replace(F.col(simple), r"\[\]", ""), ".", 1)
    given = rows.withColumn("_first", first)
    for names, cond in ((exact, F.col("path") == F.col("_p")), (nested, F.col("path") == F.col("_p")), (wide, F.col("path") == F.col("_p")), (own, F.col("package") == F.col("_q"))):
        given = given.join(names, cond & (F.col("_first") == F.col("_s")), "left").drop("_p", "_q", "_s")
    lower = F.col("_first").rlike(r"^\p{Ll}")  # a name in full
    here = F.concat_ws(".", F.nullif("package", F.lit("")), "_first")
    name = F.when(lower & F.col(simple).contains("."), F.col(simple)).otherwise(F.coalesce("_import", "_nested", "_own", "_wide", here))
    return given.withColumn(out, F.when(F.col(simple) != "", name)).drop("_first", "_import", "_nested", "_wide", "_own")


def supertypes(found: DataFrame) -> DataFrame:
    """class_name, parent (in full) and mode (extends or implements) of what types say that they extend and implement."""
    package = found.filter("kind = 'package'").groupBy("path").agg(F.min("name").alias("package"))
    said = found.filter("kind = 'super'").select("path", "class_name", F.col("name").alias("type"), F.col("type").alias("mode"))
    said = said.join(package, "path", "left").fillna("", ["package"])
    return resolved(said, "type", found, "parent").select("class_name", "parent", "mode").distinct()


def superclasses(found: DataFrame) -> DataFrame:
    """class_name and parent_class of each class whose parent is a class of the sources."""
    classes = found.filter("kind = 'class'").select(F.col("name").alias("parent_class")).distinct()
    return supertypes(found).filter("mode = 'extends'").select("class_name", F.col("parent").alias("parent_class")).join(classes, "parent_class", "left_semi").distinct()


def ancestors(ways: DataFrame, rounds: int = 6) -> DataFrame:
    """class_name and parent_class of all types above each one. ways are doubled in each round, so that 2 ** rounds types above one
    another are reached, and written, as the next round reads them twice; a type never is above itself, should sources claim so."""
    ways = checkpointed(ways.filter("class_name <> parent_class").distinct())
    n = ways.count()
    for _ in range(rounds):
        further = ways.join(ways.select(F.col("class_name").alias("parent_class"), F.col("parent_class").alias("top")), "parent_class").select("class_name", F.col("top").alias("parent_class"))
        ways = checkpointed(ways.unionByName(further).filter("class_name <> parent_class").distinct())
        if (now := ways.count()) == n:
            break
        n = now
    return ways


def implementors(found: DataFrame, rounds: int = 6) -> DataFrame:
    """Interface and class, for every class of the sources and each interface above it: its own, those that these
    extend, and those of its superclasses; interfaces that the sources do not declare count as they are named."""
    found = checkpointed(found.filter(F.col("kind").isin("package", "import", "class", "interface", "enum", "record", "super")))
    said = checkpointed(supertypes(found))
    above = ancestors(said.select("class_name", F.col("parent").alias("parent_class")), rounds)
    classes = found.filter(F.col("kind").isin("class", "enum", "record")).select(F.col("name").alias("class_name")).distinct()
    declared = found.filter(F.col("kind").isin("class", "enum", "record")).select(F.col("name").alias("parent_class")).distinct()
    extended = said.filter("mode = 'extends'").join(classes, "class_name", "left_semi").select(F.col("parent").alias("parent_class")).distinct()
    interfaces = above.join(classes, "class_name", "left_semi").join(declared, "parent_class", "left_anti").join(extended, "parent_class", "left_anti")
    return interfaces.select(F.col("parent_class").alias("interface"), F.col("class_name").alias("class"))


def declarations(found: DataFrame) -> DataFrame:
    """path, name, type, owner (the type whose file and package the type's name is read in), begin and end of every variable: parameters and
    locals, and fields in the bodies of their own types and of all types below these."""
    bodies = found.filter("kind = 'body'").select("path", "class_name", "begin", "end")
    variables = found.filter(F.col("kind").isin("param", "local")).select("path", "name", "type", F.col("path").alias("type_path"), F.lit(2).alias("rank"), "begin", "end")
    fields = found.filter("kind = 'field'").select("path", "class_name", "name", "type", F.col("begin").alias("at"))
    own = fields.join(bodies, ["path", "class_name"]).filter(F.col("at") == F.col("begin")).select("path", "name", "type", F.col("path").alias("type_path"), F.lit(1).alias("rank"), "begin", "end")
    above = ancestors(superclasses(found))
    # a private field is not inherited, but injected ones are reached all the same by what the class above does with them
    inherited = above.join(fields.select(F.col("class_name").alias("parent_class"), F.col("path").alias("type_path"), "name", "type"), "parent_class")
    inherited = inherited.join(bodies, "class_name").select("path", "name", "type", "type_path", F.lit(0).alias("rank"), "begin", "end")
    return own.unionByName(inherited).unionByName(variables)


def call_edges(found: DataFrame, lexical: bool = True) -> DataFrame:
    """Call records. What a call's receiver is: `this` and `super` are the own type; a name in capitals is a type; any other name
    is the innermost variable of that name whose part of the file holds the call: a local, a parameter, a field of a type around it, own or inherited.
    A call without a receiver is UNKNOWN, but for one imported statically.

    lexical=False knows less: fields only, by name in the whole file, of which the last one counts, and neither static imports nor imports of whole packages.
    """
    found = checkpointed(found)  # read once, used many times
    package = found.filter("kind = 'package'").groupBy("path").agg(F.min("name").alias("package"))
    calls = found.filter("kind = 'call'").filter(~is_trivial_call(F.col("name")))
    calls = calls.select("path", F.col("class_name").alias("caller_class"), F.col("method").alias("caller_method"), F.col("name").alias("callee_method"), F.col("type").alias("scope"), "root", F.col("begin_line").alias("line"), F.col("begin").alias("at"))
    calls = calls.join(package, "path", "left").fillna("", ["package"])
    # a receiver is a variable's name, also behind this, or the type that a chain begins with
    alone = F.col("scope").rlike(r"^[\w$]+$") & ~F.col("scope").isin("this", "super")
    if lexical:
        variable = F.when(alone, F.col("scope")).when(F.col("scope").rlike(r"^this\.[\w$]+$"), F.expr("substring(scope, 6)"))
        out = innermost(calls.withColumn("name", variable), declarations(found), ["path", "name"], "at", "begin", "end", ["rank", "type", "type_path"])
        out = out.select(*calls.columns, "found_type", "found_type_path")
    else:
        fields = found.filter("kind = 'field'").groupBy("path", F.col("name").alias("scope")).agg(F.max_by("type", "begin_line").alias("found_type"))
        out = calls.join(fields, ["path", "scope"], "left").withColumn("found_type_path", F.col("path"))
    first = F.when(F.col("scope") != "", F.substring_index("scope", ".", 1)).otherwise(F.col("root"))
    capital = first.rlike(r"^\p{Lu}")
    by_type = F.col("found_type").isNotNull() if lexical else F.col("found_type").isNotNull() & ~capital
    written = F.when(F.col("scope").isin("this", "super"), None).when(by_type, F.col("found_type")).when(capital, first)
    files = package.select(F.col("path").alias("_path"), F.col("package").alias("_package"))
    out = out.withColumn("written", written).withColumnRenamed("path", "file_path").withColumn("path", F.when(by_type, F.col("found_type_path")).otherwise(F.col("file_path")))
    out = out.drop("package").join(files, F.col("path") == F.col("_path"), "left").withColumn("package", F.coalesce("_package", F.lit(""))).drop("_path", "_package")
    if lexical:
        out = resolved(out, "written", found, "callee")
        imported = found.filter("kind = 'import' and type = 'static'").groupBy(F.col("path").alias("file_path"), F.substring_index("name", ".", -1).alias("callee_method")).agg(F.min(F.regexp_replace("name", r"\.[^.]*$", "")).alias("_static"))
        own = found.filter("kind = 'method'").select(F.col("path").alias("file_path"), F.col("name").alias("callee_method")).distinct()
        out = out.join(imported.join(own, ["file_path", "callee_method"], "left_anti"), ["file_path", "callee_method"], "left")
        callee = F.when((F.col("scope") == "") & (F.col("root") == ""), F.col("_static")).otherwise(F.col("callee"))
    else:
        imports = found.filter("kind = 'import' and type = '' and not endswith(name, '*')").groupBy("path", F.substring_index("name", ".", -1).alias("written")).agg(F.max("name").alias("_import"))
        out = out.join(imports, ["path", "written"], "left")
        callee = F.coalesce("_import", F.when(F.col("written").isNotNull(), F.concat_ws(".", F.nullif("package", F.lit("")), "written")))
    callee = F.when(F.col("scope").isin("this", "super"), F.col("caller_class")).otherwise(F.coalesce(callee, F.lit("UNKNOWN")))
    out = out.select("caller_class", "caller_method", callee.alias("callee_class"), "callee_method", F.lit("DIRECT").alias("call_type"), "file_path", F.col("line").alias("line_number"), F.lit(None).cast("string").alias("confidence"))
    return out.filter(~is_infrastructure_call(F.col("callee_method"), F.col("callee_class"))).distinct()


def injected_fields(found: DataFrame, rounds: int = 6) -> DataFrame:
    """Injected fields of each class, those of all classes above it included."""
    own = found.filter("kind = 'field'").filter(F.arrays_overlap("annotations", F.array(*[F.lit(a) for a in INJECTED]))).select("class_name", F.col("name").alias("field"), F.col("type").alias("field_type"))
    inherited = ancestors(superclasses(found), rounds).join(own.withColumnRenamed("class_name", "parent_class"), "parent_class").select("class_name", "field", "field_type")
    return own.unionByName(inherited).distinct()


def method_body(methods: DataFrame, files: DataFrame) -> DataFrame:
    """The source lines of each method."""
    lines = F.split("content", "\n", -1)
    body = F.array_join(F.slice(lines, F.col("begin_line"), F.col("end_line") - F.col("begin_line") + 1), "\n")
    return methods.join(files, "path").select("path", "class_name", "name", body.alias("body"))


def first_declared(methods: DataFrame) -> DataFrame:
    """The line of each name's first declaration."""
    w = Window.partitionBy("path", "name").orderBy("begin_line")
    return methods.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("path", "name", "begin_line")
