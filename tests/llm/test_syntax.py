"""Valid and broken code of every language, judged by the grammars alone."""

import datetime as dt

import pytest

from siftspark.llm import syntax

from . import snippets

EXT = {"python": "py", "javascript": "jsx", "typescript": "tsx", "go": "go", "rust": "rs", "java": "java", "csharp": "cs", "ruby": "rb", "c": "c", "cpp": "cpp", "kotlin": "kt", "swift": "swift", "php": "php", "json": "json"}
# Whole files of constructs that stand outside of functions.
FILES = {
    "rust": ["async fn f() {}", "fn f<T>(a: T) -> Vec<Vec<u8>> where T: Send {\n    a\n}", "macro_rules! m {\n    ($x:expr) => { $x + 1 };\n}", "pub(crate) trait A: B + 'static {\n    type C: D;\n    fn e(&self) -> u8 { 1 }\n}"],
    "c": ["#include <a.h>\nAPI_EXPORT status_t go(void);\nstatic inline int f(int a, ...) { return a; }\n", "typedef int (*fn)(void *);\nextern const char *names[];\n"],
    "cpp": ["template <typename T, int N = 3>\nclass A : public B<T>, private C {\npublic:\n    A() : b(1), c{2} {}\n    virtual ~A() = default;\nprivate:\n    T b;\n};\n"],
    "go": ["package x\n\ntype N interface{ ~int | ~string }\n\nfunc F[U ~int, V any](a U) V {\n\tvar v V\n\treturn v\n}\n", "package x\n\nimport (\n\t\"a\"\n\tb \"c/d\"\n)\n\nconst (\n\tA = iota\n\tB\n)\n"],
    "java": ["package a.b;\nimport static c.D.*;\n@A(b = 1)\npublic sealed interface C<T extends D & E> permits F, G {\n    default void h() {}\n}\n", "public enum E { A(1) { void f() {} }, B; private int x; E(int... y) {} }\n"],
    "csharp": ["namespace A.B;\n\npublic record C(int D, string? E = null);\n\n[F(1)]\npublic partial class G<T> : H, I<T> where T : J, new()\n{\n    public int K { get; init; } = 1;\n    public string L => M;\n    event N O;\n    public static G<T> operator +(G<T> a, G<T> b) => a;\n}\n"],
    "kotlin": ["package a\n\nsealed interface A<out T> {\n    val b: Int get() = 1\n    suspend fun c()\n}\n\nfun String.d(): Int = 1\n"],
    "swift": ["import A\n\n@main\nfinal class B: C {\n    init() throws { }\n    var d: Int { 1 }\n}\n"],
    "php": ["<?php\nnamespace A;\n\nuse B\\C;\n\nfinal class D extends C {\n    public function e(): void {}\n}\n"],
}


@pytest.fixture(scope="module")
def judged(spark):
    rows, want = [], {}
    for lang in snippets.STATEMENTS:
        for kind, parts in (("valid", snippets.pieces(lang)), ("broken", snippets.BROKEN[lang])):
            for p in parts:
                want[len(rows)] = (lang, kind, p)
                rows.append((len(rows), lang, snippets.whole(lang, p)))
        for p in FILES.get(lang, []):
            want[len(rows)] = (lang, "valid", p)
            rows.append((len(rows), lang, p))
    t0 = dt.datetime(2024, 1, 1)
    files = spark.createDataFrame([(i, "r", f"d/f{i}.{EXT[lang]}", t0) for i, lang, _ in rows], "file_id long, repo string, path string, indexed_at timestamp")
    lines = spark.createDataFrame([(i, k + 1, x) for i, _, t in rows for k, x in enumerate(t.split("\n"))], "file_id long, line_no int, content string")
    got = {r.file_id: r.valid for r in syntax.invalid(files, lines, exact=False).collect()}
    return [(*want[i], got[i]) for i in want]


@pytest.mark.parametrize("lang", snippets.STATEMENTS)
def test_language(judged, lang):
    valid = [p for x, kind, p, ok in judged if x == lang and kind == "valid" and not ok]
    broken = [(p, ok) for x, kind, p, ok in judged if x == lang and kind == "broken"]
    assert valid == []
    assert sum(kind == "valid" for x, kind, _, _ in judged if x == lang) >= 30 and len(broken) >= 26
    assert sum(not ok for _, ok in broken) >= 0.7 * len(broken)
    if lang in ("python", "json"):
        assert not any(ok for _, ok in broken)


def test_most_broken_code_is_found(judged):
    broken = [ok for _, kind, _, ok in judged if kind == "broken"]
    assert len(broken) > 380 and sum(not ok for ok in broken) >= 0.88 * len(broken)


def test_too_deep_is_not_invalid():
    assert syntax._parses("x = 1", "python") and not syntax._parses("x = = 1", "python")
    assert syntax._parses("[" * 200_000 + "]" * 200_000, "json") and not syntax._parses("[1,]", "json")
