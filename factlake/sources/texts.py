"""Source texts derived from the star-schema tables: Java classes, mapper XML, diffs and JSON reports.

No corpus of source code comes with the data, so texts are written by SQL that Spark and other engines share. They
hold what extraction has to cope with: comments and strings that look like code, overloads, several statements of a
kind, fragments, CDATA, quoted marks, members that are missing.
"""

from __future__ import annotations

import re

_MARK = re.compile(r"<<(.*?)>>", re.S)
#: characters that one of the engines would read in a literal, by number
_NUMBERED = {c: f"chr({ord(c)})" for c in "{}$\\\n\t'#"}


def text_sql(template: str) -> str:
    """An expression for the template, with <<expressions>> put in as strings."""
    parts = []
    for i, piece in enumerate(_MARK.split(template)):
        if i % 2:
            parts.append(f"CAST({piece} AS STRING)")
            continue
        for run in re.split(r"([{}$\\\n\t'#])", piece):
            if run:
                parts.append(_NUMBERED.get(run, f"'{run}'"))
    return " || ".join(parts)


JAVA = """package com.p<<k % 7>>;

import com.p<<(k + 1) % 7>>.C<<(k + 1) % n>>Mapper;
import com.p<<h % 7>>.C<<h>>ServiceImpl;
import static org.tool.U<<k % 4>>.run;

/* class Fake { void gone() { lost.call(); } } */
@Service
public class C<<k>>ServiceImpl extends C<<h>>ServiceImpl implements I<<k % 9>> {
    @Autowired
    private C<<(k + 1) % n>>Mapper mapper;
    @Value("${app.k<<k % 3>>}")
    private String size;

    @Override
    public int run<<k % 3>>(int a) {
        // mapper.commented(a);
        mapper.find<<k % 4>>(a);
        this.help(null);
        U<<k % 4>>.check("x.fake(1)");
        return a;
    }

    private void help(Object o) {
        if (o == null) {
            log(o.toString());
        }
    }

    private void help(Object o, int n) {
        Object b = context.getBean("b<<k % 6>>");
        mapper.save(b);
    }
}
"""

#: Java files of several shapes for each key. What a call resolves to stands behind it: `//= class|method|callee class|callee method`, several parted by
#: a semicolon; `//+ interface|class` says who implements what. Both are comments, which Java's readers skip.
SHAPES = {
    "Base": """package com.g<<k>>;
public abstract class Base<<k>><T extends Comparable<T>> implements J<<k>> { //+ com.g<<k>>.J<<k>>|com.g<<k>>.Base<<k>>
    protected Repo<<k>> repo;
    @Autowired private Dao<<k>> dao;
    abstract T open(int a);
    void load(Dao<<k>> other) {
        other.find(1); //= com.g<<k>>.Base<<k>>|load|com.g<<k>>.Dao<<k>>|find
        /* dao.lost(); */ String s = "dao.lost(1)"; char c = '"';
        dao.find(2); //= com.g<<k>>.Base<<k>>|load|com.g<<k>>.Dao<<k>>|find
    }
}
interface J<<k>> { }
interface I<<k>> extends J<<k>>, java.io.Closeable { default void shut(Repo<<k>> r) { r.save(0); } } //= com.g<<k>>.I<<k>>|shut|com.g<<k>>.Repo<<k>>|save
class Repo<<k>> { }
class Dao<<k>> { }
""",
    "Child": """package com.g<<k>>;
import com.w<<k>>.*;
import com.v<<k % 3>>.Mail;
import static com.v<<k % 3>>.Mail.send;
//+ com.g<<k>>.I<<k>>|com.g<<k>>.Child<<k>>
//+ com.g<<k>>.J<<k>>|com.g<<k>>.Child<<k>>
//+ java.io.Closeable|com.g<<k>>.Child<<k>>
//+ com.g<<k>>.Runnable|com.g<<k>>.Child<<k>>
@Service(value = "a{b}", names = {"x", "y"})
public class Child<<k>> extends Base<<k>><String> implements I<<k>>, Runnable {
    private final Map<String, List<Dao<<k>>>> known = new HashMap<>(), other;
    Mail mail, spare;
    @Autowired
    I<<k>> self;
    int[] sizes = {1, count(2), 3}; //= com.g<<k>>.Child<<k>>||UNKNOWN|count
    static { Mail.warm(); } //= com.g<<k>>.Child<<k>>||com.v<<k % 3>>.Mail|warm
    Child<<k>>(Dao<<k>> mail) { super(); mail.find(3); } //= com.g<<k>>.Child<<k>>||com.g<<k>>.Dao<<k>>|find
    public void run() {
        repo.save(1); this.mail.post(); //= com.g<<k>>.Child<<k>>|run|com.g<<k>>.Repo<<k>>|save;com.g<<k>>.Child<<k>>|run|com.v<<k % 3>>.Mail|post
        spare.post(); //= com.g<<k>>.Child<<k>>|run|com.v<<k % 3>>.Mail|post
        if (spare != null) {
            Mail repo = spare;
            repo.draft(); //= com.g<<k>>.Child<<k>>|run|com.v<<k % 3>>.Mail|draft
        }
        repo.drop(); //= com.g<<k>>.Child<<k>>|run|com.g<<k>>.Repo<<k>>|drop
        Tool<<k>> tool = new Tool<<k>>(), more;
        tool.use(); //= com.g<<k>>.Child<<k>>|run|com.w<<k>>.Tool<<k>>|use
        send("m"); helper(); //= com.g<<k>>.Child<<k>>|run|com.v<<k % 3>>.Mail|send;com.g<<k>>.Child<<k>>|run|UNKNOWN|helper
        this.helper(); super.load(null); //= com.g<<k>>.Child<<k>>|run|com.g<<k>>.Child<<k>>|helper;com.g<<k>>.Child<<k>>|run|com.g<<k>>.Child<<k>>|load
        nobody.knows(); //= com.g<<k>>.Child<<k>>|run|UNKNOWN|knows
    }
    void params(Dao<<k>> mail, Mail... all) throws java.io.IOException, Gone {
        mail.find(3); //= com.g<<k>>.Child<<k>>|params|com.g<<k>>.Dao<<k>>|find
        for (Mail m : all) { m.post(); } //= com.g<<k>>.Child<<k>>|params|com.v<<k % 3>>.Mail|post
        try (Tool<<k>> t = tool(1)) { //= com.g<<k>>.Child<<k>>|params|UNKNOWN|tool
            t.use(); //= com.g<<k>>.Child<<k>>|params|com.w<<k>>.Tool<<k>>|use
        } catch (Lost | Gone e) {
            e.report(); //= com.g<<k>>.Child<<k>>|params|com.g<<k>>.Lost|report
        }
    }
}
""",
    "Flow": """package com.g<<k>>;
import com.v<<k % 3>>.Mail;
class Flow<<k>> {
    Mail mail;
    private final Runnable job = new Runnable() {
        Repo<<k>> inner = new Repo<<k>>();
        @Override public void run() {
            inner.save(2); mail.post(); //= com.g<<k>>.Flow<<k>>|run|com.g<<k>>.Repo<<k>>|save;com.g<<k>>.Flow<<k>>|run|com.v<<k % 3>>.Mail|post
        }
    };
    <R extends Repo<<k>>> List<R> each(List<R> rows, Dao<<k>> dao) {
        rows.order((a, mail) -> { mail.none(); return dao.rank(a); }); //= com.g<<k>>.Flow<<k>>|each|com.g<<k>>.List|order;com.g<<k>>.Flow<<k>>|each|UNKNOWN|none;com.g<<k>>.Flow<<k>>|each|com.g<<k>>.Dao<<k>>|rank
        mail.post(); //= com.g<<k>>.Flow<<k>>|each|com.v<<k % 3>>.Mail|post
        Mail.make("y").later(); //= com.g<<k>>.Flow<<k>>|each|com.v<<k % 3>>.Mail|make;com.g<<k>>.Flow<<k>>|each|com.v<<k % 3>>.Mail|later
        var r = new Repo<<k>>();
        rows.order(mail -> mail.none()); r.save(3); //= com.g<<k>>.Flow<<k>>|each|com.g<<k>>.List|order;com.g<<k>>.Flow<<k>>|each|UNKNOWN|none;com.g<<k>>.Flow<<k>>|each|com.g<<k>>.Repo<<k>>|save
        switch (rows.count()) { //= com.g<<k>>.Flow<<k>>|each|com.g<<k>>.List|count
            case 1: Dao<<k>> d = dao; d.find(4); break; //= com.g<<k>>.Flow<<k>>|each|com.g<<k>>.Dao<<k>>|find
            default: r.drop(); //= com.g<<k>>.Flow<<k>>|each|com.g<<k>>.Repo<<k>>|drop
        }
        return new Keep<R>() { void kept() { r.keep(); } }; //= com.g<<k>>.Flow<<k>>|kept|com.g<<k>>.Repo<<k>>|keep
    }
}
""",
    "Nest": """package com.g<<k>>;
public class Nest<<k>> {
    Repo<<k>> repo;
    enum Kind { ONE { void go(Dao<<k>> a) { a.find(7); } }, TWO(2); Kind(int... n) { } } //= com.g<<k>>.Nest<<k>>.Kind|go|com.g<<k>>.Dao<<k>>|find
    record Pair(Repo<<k>> left, int n) implements J<<k>> { Pair { check(n); } void t() { left.save(n); } } //= com.g<<k>>.Nest<<k>>.Pair||UNKNOWN|check;com.g<<k>>.Nest<<k>>.Pair|t|com.g<<k>>.Repo<<k>>|save
    //+ com.g<<k>>.J<<k>>|com.g<<k>>.Nest<<k>>.Pair
    static class Inner extends Child<<k>> {
        Kind kind;
        //+ com.g<<k>>.I<<k>>|com.g<<k>>.Nest<<k>>.Inner
        //+ com.g<<k>>.J<<k>>|com.g<<k>>.Nest<<k>>.Inner
        //+ java.io.Closeable|com.g<<k>>.Nest<<k>>.Inner
        //+ com.g<<k>>.Runnable|com.g<<k>>.Nest<<k>>.Inner
        void all() {
            mail.post(); repo.save(8); kind.go(null); //= com.g<<k>>.Nest<<k>>.Inner|all|com.v<<k % 3>>.Mail|post;com.g<<k>>.Nest<<k>>.Inner|all|com.g<<k>>.Repo<<k>>|save;com.g<<k>>.Nest<<k>>.Inner|all|com.g<<k>>.Nest<<k>>.Kind|go
        }
    }
    void text() {
        String s = """ + '"' * 3 + """
            class Fake { void y() { no.no(); } } """ + '"' * 3 + """; // no.never()
        class Local { Dao<<k>> q; void h() { q.find(9); } } //= com.g<<k>>.Nest<<k>>.Local|h|com.g<<k>>.Dao<<k>>|find
        repo.save(10); //= com.g<<k>>.Nest<<k>>|text|com.g<<k>>.Repo<<k>>|save
    }
}
""",
    "Tool": """package com.w<<k>>;
@interface Mark { String value() default "{"; }
public class Tool<<k>> implements AutoCloseable { //+ com.w<<k>>.AutoCloseable|com.w<<k>>.Tool<<k>>
    @Mark("}") int use() { return this.use(); } //= com.w<<k>>.Tool<<k>>|use|com.w<<k>>.Tool<<k>>|use
}
""",
}

MAPPER = """<?xml version="1.0"?>
<!DOCTYPE mapper PUBLIC "-//x//DTD Mapper 3.0//EN" "http://x/mapper.dtd">
<mapper namespace="com.p<<k % 7>>.C<<k>>Mapper">
  <resultMap id="rm" type="com.dto.D<<k % 11>>">
    <id property="id" column="id"/>
    <result property="name<<k % 3>>" column="c_<<k % 13>>"/>
  </resultMap>
  <sql id="cols">a.id, a.c_<<k % 13>></sql>
  <select id="find<<k % 4>>"
          resultMap="rm">
    SELECT <include refid="cols"/> FROM t_<<k % 17>> a LEFT JOIN x_<<k % 5>> x ON a.id = x.id
    <where><if test="id != null">AND a.id = #{id}</if></where> ORDER BY a.c_<<k % 13>> DESC
  </select>
  <insert id="save">INSERT INTO t_<<k % 17>> (id, c_<<k % 13>>) VALUES (#{id}, #{v})</insert>
  <update id="touch"><![CDATA[UPDATE t_<<k % 17>> SET c_<<k % 13>> = 1 WHERE id < 5 AND d IN (1, 2)]]></update>
  <delete id="drop">DELETE FROM x_<<k % 5>> WHERE e BETWEEN 1 AND <<k>></delete>
</mapper>
"""

DIFF = """diff --git a/src/main/java/com/p<<k % 7>>/A<<k>>.java b/src/main/java/com/p<<k % 7>>/A<<k>>.java
index 1..2 100644
--- a/src/main/java/com/p<<k % 7>>/A<<k>>.java
+++ b/src/main/java/com/p<<k % 7>>/A<<k>>.java
@@ -<<1 + k % 5>>,3 +<<2 + k % 5>>,4 @@
 package com.p<<k % 7>>;
-import com.Old;
+import com.New<<k % 3>>;
+<<CASE WHEN k % 2 = 0 THEN '    public void run' || CAST(k % 4 AS STRING) || '(int a) (' ELSE '    // a note' END>>
@@ -20,2 +21,2 @@
     private static int keep(int x) {
<<CASE WHEN k % 3 = 0 THEN '+        return x;' ELSE '+        /* only a comment */' END>>
diff --git a/src/test/java/com/B<<k>>.java b/src/test/java/com/B<<k>>.java
new file mode 100644
--- /dev/null
+++ b/src/test/java/com/B<<k>>.java
@@ -0,0 +1,2 @@
+import com.X;
+<<CASE WHEN k % 4 = 0 THEN 'class B (' ELSE '' END>>
diff --git a/notes.md b/notes.md
--- a/notes.md
+++ b/notes.md
@@ -1 +1 @@
-a
+b
diff --git a/src/Gone<<k>>.java b/src/Gone<<k>>.java
deleted file mode 100644
--- a/src/Gone<<k>>.java
+++ /dev/null
@@ -1,2 +0,0 @@
-class Gone (
-    private void bye() (
diff --git a/src/Pic.java b/src/Pic.java
Binary files a/src/Pic.java and b/src/Pic.java differ
"""

REPORT = """{"class": "com.p<<k % 7>>.C<<k>>", "overall_complexity": "<<CASE k % 3 WHEN 0 THEN 'LOW' ELSE 'HIGH' END>>", "contradiction_count": <<k % 4>>,
 "architecture_issues": [1], "methods": [
 {"name": "a", "line": "<<5 + k % 3>>", "complexity": "<<CASE k % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'LOW' ELSE 'MEDIUM' END>>", "complexity_value": "<<k % 11>>",
  "calls": [{"target": "b(1, 2)", "line": "9", "type": "same"}, {"target": "this.c", "line": 7}, {"target": "this.dao.save", "line": "x", "tag": "[FACT]"}, {"target": "o<<k % 5>>.go"}],
  "called_by": [{"caller": "x.c", "line": 1}], "risks": [{"type": "security", "description": "r<<k % 6>>", "line": "<<k % 30>>", "severity": "HIGH", "confidence": "LIKELY", "tag": "[FACT]"}]},
 {"name": "b", "line": 12, "complexity": "HIGH", "complexity_value": 8, "calls": [{"target": "a"}, {"target": "b"}], "called_by": [{"caller": "<<CASE k % 2 WHEN 0 THEN 'q.a' ELSE 'z' END>>"}], "risks": []},
 {"name": "c", "line": 40, "complexity": "MEDIUM", "complexity_value": 5, "calls": [], "called_by": []}],
 "risks": [{"type": "SECURITY", "description": "top <<k % 4>>", "line": 3, "severity": "LOW", "confidence": "CERTAIN"}, {"type": "odd", "description": "t2", "line": 1}, {"description": "t3"}, {"description": "t4"}],
 "dependencies": [{"name": "com.x.IOrder<<k % 5>>Service", "type": "injection", "line": "12"}, {"name": "StringUtils", "type": "field", "line": 2}, {"name": "FooServiceImpl", "type": "field", "line": 4},
  {"name": "java.util.List", "type": "field", "line": "x"}, {"name": "com.a.IBillCmd.query(1)", "type": "field", "line": 1}, {"name": "b.run", "type": "method_call", "line": <<k % 60>>}, {"name": "lost", "type": "method_call"}],
 "keyMethods": [{"name": "m1", "line": 10, "calls": [{"target": "z(1)"}]}, {"name": "m2", "line": "30"}, {"name": "m3", "line": "?"}]}"""


BROKEN = (
    """{"a": "say "hi" <<k>>", "b": <<k % 7>>}""", """{"m": [{"a": 1}, {"n": <<k>>}, {"b": 2, "c": "cut of <<k>>""", """{"a": "x
y\tz<<k>>"}""", """no json <<k>>""", """{"a": {"b": <<k>>}}""",
)


def _source(template: str, key: str, name: str, select: str) -> str:
    return f"SELECT {key} AS {name}, {text_sql(template)} AS {select} FROM "


_SUPPLIERS = "(SELECT s_suppkey AS k, CAST(floor(s_suppkey / 2) AS BIGINT) AS h, (SELECT count(*) FROM {supplier}) AS n FROM {supplier}) x"
_CUSTOMERS = "(SELECT c_custkey AS k FROM {customer}) x"
_JAVA_PATH = "'app' || CAST(k % 3 AS STRING) || '/src/main/java/com/p' || CAST(k % 7 AS STRING) || '/C' || CAST(k AS STRING) || 'ServiceImpl.java'"
_XML_PATH = "'mapper/m' || CAST(k % 3 AS STRING) || '/C' || CAST(k AS STRING) || 'Mapper.xml'"
VIEWS = {
    "java_files": _source(JAVA, _JAVA_PATH, "path", "content") + _SUPPLIERS,
    "java_shapes": " UNION ALL ".join(_source(t, f"'src/main/java/com/g' || CAST(k AS STRING) || '/{n}' || CAST(k AS STRING) || '.java'", "path", "content") + "(SELECT s_suppkey AS k FROM {supplier}) x" for n, t in SHAPES.items()),
    "broken_json": "SELECT k AS doc, CASE k % 5 " + " ".join(f"WHEN {i} THEN {text_sql(t)}" for i, t in enumerate(BROKEN)) + " END AS text FROM " + _CUSTOMERS,
    "mapper_files": _source(MAPPER, _XML_PATH, "path", "content") + _SUPPLIERS,
    "diff_texts": _source(DIFF, "k", "diff_id", "diff") + _CUSTOMERS,
    "report_texts": _source(REPORT, "k", "doc", "json") + _CUSTOMERS,
}
