import pytest

from tessera.sources import frontends  # noqa: F401
from tessera.sources.languages import FRONTENDS, LANGUAGES, language_of, register

APP = """export interface Person { name: string }
export function greet(p: Person): string { return helper(p.name); }
export class Greeter { sayHello(name: string) { if (name) { return greet({ name }); } return name; } }
const helper = (n: string) => n + "!";
const later = greet;
"""
TOOL = """class Runner:
    def execute(self, n):
        for i in range(n):
            if i > 2:
                return greet_python(i)
        return 0

def greet_python(name):
    return Runner().execute(name)
"""


def metrics(out):
    """Name, complexity and depth of each function, from its nodes."""
    held = {}
    for n in out.nodes:
        held.setdefault((n["start"], n["stop"], n["name"]), []).append(n)
    return [(name, 1 + sum(n["is_branch"] for n in own), max(n["depth"] for n in own)) for (_, _, name), own in sorted(held.items())]


def names(language, text):
    return [(d["kind"], d["name"], d["container"]) for d in FRONTENDS[language](text).definitions]


def test_script_definitions():
    assert names("typescript", APP) == [("interface", "Person", None), ("function", "greet", None), ("class", "Greeter", None), ("method", "sayHello", "Greeter"), ("variable", "helper", None)]


def test_script_references():
    refs = [r for r in FRONTENDS["typescript"](APP).references if r["name"] == "greet"]
    assert [(r["ref_kind"], r["encl_kind"], r["encl_name"]) for r in refs] == [("call", "method", "sayHello"), ("reference", "function", "later")]


def test_python_rows():
    out = FRONTENDS["python"](TOOL)
    assert [(d["kind"], d["name"], d["container"]) for d in out.definitions] == [("class", "Runner", None), ("method", "execute", "Runner"), ("function", "greet_python", None)]
    assert [(c["callee"], c["chain"]) for c in out.calls] == [("range", ["execute"]), ("greet_python", ["execute"]), ("Runner", ["greet_python"]), ("Runner().execute", ["greet_python"])]
    assert next(r for r in out.references if r["name"] == "greet_python")["encl_name"] == "execute"
    assert metrics(out) == [("execute", 5, 2), ("greet_python", 2, 0)]


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("javascript", "function f() { return 1 }\nconst g = function (x) { return x }\nclass H { run() { return f() } }\n", [("function", "f"), ("variable", "g"), ("class", "H"), ("method", "run")]),
        ("java", "public class A { enum E { X } interface I { void f(); } A(int x) { } public int run(String s) throws Ex { return go(s); } }", [("class", "A"), ("class", "E"), ("variable", "X"), ("interface", "I"), ("method", "f"), ("method", "A"), ("method", "run")]),
        ("csharp", "namespace N { public class A { int Run(int x) { return Go(x); } } struct S { } interface I { } }", [("variable", "N"), ("class", "A"), ("method", "Run"), ("class", "S"), ("interface", "I")]),
        ("go", "package p\ntype T struct { a int }\nfunc (t *T) Run(x int) int { return help(x) }\nfunc help(x int) int { return x }", [("class", "T"), ("method", "Run"), ("function", "help")]),
        ("rust", "struct S { a: i32 }\nimpl S { fn run(&self) -> i32 { help(1) } }\ntrait T { fn f(&self); }\nfn help(x: i32) -> i32 { x }", [("class", "S"), ("class", "S"), ("method", "run"), ("interface", "T"), ("function", "help")]),
        ("c", "struct P { int x; };\nint *add(int a, int b) { return sum(a, b); }\nstatic void go(void) { add(1, 2); }", [("class", "P"), ("function", "add"), ("function", "go")]),
        ("cpp", "namespace n { class A { public: int run(int x) const { return x; } }; }\nint main() { A a; a.run(1); }", [("variable", "n"), ("class", "A"), ("method", "run"), ("function", "main")]),
    ],
)
def test_brace_languages(language, text, want):
    assert [x[:2] for x in names(language, text)] == want


def test_calls_of_java_are_listed_but_index_as_references():
    out = FRONTENDS["java"]("class A { int f() { return g(1); } int g(int x) { return x; } }")
    assert [c["callee"] for c in out.calls] == ["g"]
    assert {r["ref_kind"] for r in out.references} == {"reference"}


@pytest.mark.parametrize(("language", "text"), [("typescript", "function broken( { "), ("python", "def f(:"), ("c", "int f() { } }")])
def test_broken_files_give_no_rows(language, text):
    out = FRONTENDS[language](text)
    assert out.failure and not out.definitions and not out.references


@pytest.mark.parametrize("language", sorted(LANGUAGES))
def test_empty_text(language):
    out = FRONTENDS[language]("")
    assert out.failure is None and not out.definitions and not out.references and not out.calls


def test_language_table():
    assert sorted(LANGUAGES) == "c cpp csharp go java javascript python rust tsx typescript".split()
    assert [language_of(p) for p in ("a/b.TS", "a.tsx", "x.h++", "README.md", "noext", "a.d/b")] == ["typescript", "tsx", "cpp", None, None, None]
    with pytest.raises(ValueError):
        register("python", lambda t: t)
    with pytest.raises(ValueError):
        register("other", lambda t: t, (".py",))


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("cpp", "int add(int a, const T& b);\nnamespace n { void go(); }\nint main() { A a(1); int x = add(1, 2); return go(x); }", [("function", "add"), ("variable", "n"), ("function", "go"), ("function", "main")]),
        ("cpp", "void go() { if (not ok(x)) co_return more(y); else less(z); do again(w); while (x); }", [("function", "go")]),
        ("cpp", "typedef unsigned long Size;\ntypedef struct { int x; } Pair;\nstruct S { int f(int x); };", [("variable", "Size"), ("variable", "Pair"), ("class", "S")]),
        ("c", "typedef struct P { int x; } Q;\ntypedef int Row[4];", [("variable", "Q"), ("class", "P"), ("variable", "Row")]),
        ("csharp", "delegate int Op(int x);\ninterface I { int Run(int x); }\nabstract class A { public abstract void Go(); void Do() { Go(); } }", [("variable", "Op"), ("interface", "I"), ("function", "Run"), ("class", "A"), ("method", "Go"), ("method", "Do")]),
        ("java", "@interface Mark { }\nenum E { A(1) { int f() { return 1; } }, @Old B, C; int g() { return 2; } }", [("interface", "Mark"), ("class", "E"), ("variable", "A"), ("method", "f"), ("variable", "B"), ("variable", "C"), ("method", "g")]),
        ("cpp", "template <class T> auto f(T x) noexcept(noexcept(g(x))) -> decltype(g(x) + h(x) + k(x) + m(x) + n(x)) { return g(x); }", [("function", "f")]),
    ],
)
def test_more_definitions(language, text, want):
    got = [x[:2] for x in names(language, text)]
    assert [x for x in got if x in want] == want and len(got) <= len(want) + (language == "cpp" and "template" in text)


def test_calls_through_calls():
    text = "function f() { return first(arg).second(b).third; }\nconst x = new Box(f());"
    out = FRONTENDS["javascript"](text)
    refs = {r["name"]: (r["ref_kind"], text[r["start"] : r["stop"]]) for r in out.references}
    assert refs["first"] == ("call", "first(arg)") and refs["second"] == ("call", "first(arg).second(b)")
    assert refs["arg"] == ("call", "first(arg).second(b)") and refs["b"][0] == refs["third"][0] == "reference"
    assert refs["Box"] == ("call", "new Box(f())") and [c["callee"] for c in out.calls] == ["first", "first(arg).second", "Box", "f"]


def test_implements():
    rows = FRONTENDS["typescript"]("class A extends B implements C, D { run() { return 1; } }").definitions
    assert (rows[0]["base"], rows[0]["implements"]) == ("B", "C, D")


def test_snippets_are_those_of_the_column_functions(spark):
    from pyspark.sql import functions as F

    from tessera.functions import snippets
    from tessera.functions import text as T

    texts = ["a  b\n c", "x" * 400, "word " * 100, "", " lead", "word  " * 30 + "end"]
    rows = spark.createDataFrame([(t, s) for t in texts for s in (0, 3, 90, 150) if s + 10 <= max(10, len(t))], "t string, s int")
    got = rows.select("t", "s", T.snippet(F.col("t")).alias("a"), T.context_snippet(F.col("t"), F.col("s"), F.col("s") + 10).alias("b")).collect()
    for r in got:
        assert (r["a"], r["b"]) == (snippets.snippet(r["t"]), snippets.context_snippet(r["t"], r["s"], r["s"] + 10))
    long = snippets.context_snippet("a " * 200, 200, 210)
    assert long.endswith("...") and not long[:-3].endswith(" ") and len(long) <= 160


def test_a_long_file_takes_time_in_proportion():
    import time

    body = "function f{i}(a) {{ if (a) {{ return g{i}(a).h(b) + 1; }} return a; }}\n"
    took = []
    for n in (1_000, 4_000):
        text = "".join(body.format(i=i) for i in range(n))
        began = time.process_time()
        out = FRONTENDS["javascript"](text)
        took.append(time.process_time() - began)
        assert len(out.definitions) == len(metrics(out)) == n
    assert took[1] < 10 * took[0]
