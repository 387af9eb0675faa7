from pyspark.sql import functions as F

from factlake.operators import diffs, implicit, sqltext
from factlake.sources import files as src
from factlake.sources import java_facts, mapper_xml

DIFF = """diff --git a/src/main/java/com/x/Foo.java b/src/main/java/com/x/Foo.java
--- a/src/main/java/com/x/Foo.java
+++ b/src/main/java/com/x/Foo.java
@@ -10,3 +10,4 @@ class Foo {
     public void run(int a) {
+        int b = 1;
     }
@@ -40,2 +41,2 @@
-    private String name() { return x; }
+    private String name() { return y; }
diff --git a/src/A.java b/src/A.java
new file mode 100644
--- /dev/null
+++ b/src/A.java
@@ -0,0 +1,2 @@
+package a;
+class A {}
diff --git a/I.java b/I.java
--- a/I.java
+++ b/I.java
@@ -1,1 +1,2 @@
 package i;
+import java.util.List;
diff --git a/readme.md b/readme.md
--- a/readme.md
+++ b/readme.md
@@ -1 +1 @@
-a
+b
diff --git a/B.java b/B.java
Binary files a/B.java and b/B.java differ
"""


def test_diffs(spark):
    df = spark.createDataFrame([(1, DIFF), (2, ""), (3, None)], "diff_id int, diff string")
    got = {r.file_path: r for r in diffs.changed_files(df).collect()}
    assert sorted(got) == ["I.java", "src/A.java", "src/main/java/com/x/Foo.java"]
    foo = got["src/main/java/com/x/Foo.java"]
    assert (foo.class_name, foo.change_type, foo.significance) == ("com.x.Foo", "MODIFIED", "HIGH")
    assert [(m.method_name, m.old_start_line, m.new_start_line) for m in foo.changed_methods] == [("run", 10, 10), ("name", 40, 41)]
    assert got["src/A.java"].change_type == "ADDED" and got["src/A.java"].changed_methods == []
    assert got["I.java"].significance == "LOW"


def test_sql_text(spark):
    rows = [
        ("SELECT", "SELECT u.user_name AS n, age FROM sys_user u LEFT JOIN db.sys_dept d ON u.id=d.id WHERE u.status = 1 AND name LIKE 'x' ORDER BY age DESC"),
        ("SELECT", "select * from t"), ("INSERT", "INSERT INTO t (a, b) VALUES (1, 2)"), ("UPDATE", "UPDATE t SET a = 1, b = 2 WHERE id = 3"), ("DELETE", "DELETE FROM t WHERE id IN (1)"), ("SELECT", None),
    ]
    df = spark.createDataFrame(rows, "k string, q string")
    got = df.select(sqltext.tables_of(F.col("q"), F.col("k")).alias("t"), sqltext.fields_of(F.col("q"), F.col("k")).alias("f")).collect()
    assert [r.t for r in got] == [["sys_user", "db"], ["t"], ["t"], ["t"], ["t"], []]
    assert got[0].f == ["user_name", "age", "status", "name"]
    assert [r.f for r in got[1:5]] == [["WILDCARD"], ["a", "b"], ["a", "b", "id"], ["id"]]


XML = """<?xml version="1.0"?><!DOCTYPE mapper PUBLIC "-//x//DTD" "http://x/y.dtd">
<mapper namespace="com.UserMapper">
  <sql id="cols">id, name</sql>
  <resultMap id="m" type="com.User"><id property="userId" column="user_id"/><result property="userName" column="user_name"/></resultMap>
  <select id="all" resultMap="m">SELECT <include refid="com.x.cols"/> FROM sys_user <where><if test="x">status = #{s}</if></where> <![CDATA[ AND id > 3 ]]></select>
  <insert
     id="add">INSERT INTO sys_user (id) VALUES (#{id})</insert>
  <delete>DELETE FROM x</delete>
</mapper>"""


def test_q01_q02_q03_mapper_xml(spark):
    df = spark.createDataFrame([("a.xml", XML), ("bad.xml", "<mapper"), ("e.xml", None)], "path string, content string")
    st = mapper_xml.statements(df)
    got = {r.method_name: r for r in st.collect()}
    assert sorted(got) == ["add", "all"] and got["all"].xml_line == 5 and got["add"].xml_line == 6
    assert got["all"].sql_text == "SELECT id, name FROM sys_user status = #{s} AND id > 3"
    ops = {r.method_name: r for r in sqltext.operations(st).collect()}
    assert ops["all"].table_name == "sys_user" and ops["add"].fields == ["id"]
    assert [(r.property_name, r.column_name, r.is_id) for r in mapper_xml.mappings(df).collect()] == [("userId", "user_id", True), ("userName", "user_name", False)]


JAVA = """package com.x;
import com.y.OrderService;
@Service
public class Foo extends Base {
    @Autowired
    private OrderService orderService; // new Foo() { }
    public String run(int a, List<String> b) throws Exception {
        if (a > 1) { orderService.create("x.y(", a); }
        helper();
        return this.name();
    }
    void run() { Util.work(); }
    private void helper() { orderService.getName(); int[] x = {1}; }
}
class Base { @Resource Dao dao; }
"""


def test_java_facts(spark):
    files = spark.createDataFrame([("src/Foo.java", JAVA), ("e.java", None)], "path string, content string")
    found = java_facts.java_facts(files).cache()
    methods = sorted((r.name, r.class_name, r.begin_line, r.end_line) for r in found.filter("kind = 'method'").collect())
    assert methods == [("helper", "com.x.Foo", 13, 13), ("run", "com.x.Foo", 7, 11), ("run", "com.x.Foo", 12, 12)]
    edges = {(r.caller_method, r.callee_class, r.callee_method) for r in java_facts.call_edges(found).collect()}
    assert ("run", "com.y.OrderService", "create") in edges and ("run", "com.x.Util", "work") in edges and ("run", "UNKNOWN", "helper") in edges
    assert not any(m == "getName" for _, _, m in edges)
    assert {(r.class_name, r.field) for r in java_facts.injected_fields(found).collect()} == {("com.x.Foo", "orderService"), ("com.x.Foo", "dao"), ("com.x.Base", "dao")}
    terms = {(r.term, r.term_type) for r in java_facts.code_terms(found).collect()}
    assert {("Foo", "CLASS"), ("Service", "ANNOTATION"), ("run", "METHOD"), ("orderService.create", "CALLEE"), ("create", "CALLEE")} <= terms
    body = java_facts.method_body(found.filter("kind = 'method' and begin_line = 12"), files).first().body
    assert body.strip() == "void run() { Util.work(); }"
    assert {r.term for r in src.imports(files).collect()} == {"com.y.OrderService", "OrderService"}


def test_lines_and_null_literals(spark):
    files = spark.createDataFrame([("a", "x = null;\nnullable\n// null\n\n\n")], "path string, content string")
    assert src.lines(files).count() == 3
    assert [r.line_number for r in src.null_literals(src.lines(files)).orderBy("line_number").collect()] == [1, 3]


def test_implicit(spark):
    text = '@Autowired private FooService foo; @Resource BarDao dao; @EventListener public void on(E e) {} @Profile("x") getBean(a) getBean(b) @Value("${a}") @Value("${b}")'
    files = spark.createDataFrame([("a", text)], "path string, content string")
    got = sorted((r.dimension, r.target, r.confidence) for r in implicit.detected(files).collect())
    assert got == sorted([
        ("SPRING_INJECTION", "FooService", "HIGH"), ("SPRING_INJECTION", "BarDao", "HIGH"), ("INTERFACE_IMPL", "FooService", "UNRESOLVED"), ("EVENT_LISTENER", "@EventListener public void on(", "HIGH"),
        ("CONDITIONAL_BEAN", "@Profile", "MEDIUM"), ("REFLECTION_CALL", "getBean", "MEDIUM"), ("CONFIG_REFERENCE", "@Value", "LOW"), ("CONFIG_REFERENCE", "@Value", "LOW"),
    ])
    assert implicit.summarised(implicit.detected(files)).first().with_findings == 6
    impls = spark.createDataFrame([("FooService", "FooA"), ("FooService", "FooB")], "interface string, class string")
    assert {(r.target, r.confidence) for r in implicit.interface_impls(files, impls).collect()} == {("FooA", "MEDIUM"), ("FooB", "MEDIUM")}


def test_diff_lines_in_segments(spark):
    """Segments of any length give what one pass gives, from whole diffs and from lines; a file or hunk may reach over many."""
    import random

    r = random.Random(3)
    rows = [(i, "\n".join(r.choice(["diff --git a/A.java b/A.java", "@@ -1,2 +3,4 @@", "+ x", "- y", " z", "+    public void run() {", "index"]) for _ in range(r.choice((0, 1, 9, 60))))) for i in range(12)] + [(99, None), (100, DIFF)]
    given = spark.createDataFrame(rows, "diff_id int, diff string")
    want = []
    for i, text in rows:
        file = hunk = 0
        for at, line in enumerate(text.split("\n") if text is not None else []):
            if line.startswith("diff --git "):
                file, hunk = file + 1, 0
            hunk += line.startswith("@@ ")
            want.append((i, at, line, file, hunk))
    lines = spark.createDataFrame([x[:3] for x in want], "diff_id int, at int, line string")
    for segment in (1, 4, 100_000):
        for source in (given, lines):
            assert sorted(map(tuple, diffs.diff_lines(source, segment).collect())) == sorted(want)
    assert {tuple(x)[:5] for x in diffs.changed_files(given, 2).collect()} == {tuple(x)[:5] for x in diffs.changed_files(given).collect()}
