"""Valid pieces of code, one a line, by language; ``WRAP`` puts a statement into a whole file."""

WRAP = {
    "python": "{}\n", "javascript": "{}\n", "typescript": "{}\n", "go": "package x\n\nfunc f() {{\n{}\n}}\n", "rust": "fn f() {{\n{}\n}}\n", "java": "class A {{\n  void f() {{\n{}\n  }}\n}}\n",
    "csharp": "class A {{\n  void F() {{\n{}\n  }}\n}}\n", "ruby": "{}\n", "c": "void f(void) {{\n{}\n}}\n", "cpp": "void f() {{\n{}\n}}\n", "kotlin": "fun f() {{\n{}\n}}\n", "swift": "func f() {{\n{}\n}}\n", "php": "<?php\n{}\n", "json": "{}\n",
}

STATEMENTS = {
    "python": r"""
x: int = 3
async def f(a, /, b, *, c=1, **d) -> None: ...
with open(a) as f, open(b) as g: pass
match = 3; type = 4; case = match
print(f"{a!r:>{w}}", end="")
lambda *a, k=1, **b: (yield)
x = [*a, *b]; y = {**c, 'd': 1}
if (n := len(a)) > 3: print(n)
@a.b(c)[0]
@property
del a[1:2], b.c
raise A(b) from None
x = a if b else c if d else e
assert isinstance(a, b), "no"
global a, b
from . import a as b, c
from ..a.b import (c, d as e,)
import a.b.c as d, e
for i, (a, b) in enumerate(c): continue
while True: break
x = a[..., 1:, ::2, None]
x @= y; z //= 2; w **= 3
x = not a in b and a is not c
print(*args, sep='', **kw)
x = 0x1F + 0b10 + 1_000 + 1e-5 + 2j
x = rb'\d' rb'a' if a else b'c'
x = {a: b for a, b in c.items() if a if b}
x = (await a for a in b)
class A(B, metaclass=C): x = 1
type X[T] = list[T]
def f[T: int](a: T) -> T: return a
try: a()
nonlocal_ = 1
""".replace("\n@a.b(c)[0]\n@property\n", "\n").replace("\ntry: a()\n", "\n"),
    "javascript": r"""
const { a, b: { c = 1 }, ...d } = e;
let [a, , b = 2, ...c] = d
export default function () {}
export const f = async ({ a, b = 1 }, ...c) => { await a; }
export * from 'a'; export { a as b } from 'c';
import a, { b as c } from 'd'; import * as e from 'f';
class A extends B { static #x = 1; get y() { return this.#x; } static { z(); } async *[k]() {} }
label: for (;;) { continue label; }
for await (const x of y) z(x);
x = a ? b : c ? d : e;
x ??= y?.z?.[1]?.(2) ?? `a${b + `c${d}`}e`;
const r = /[/\]]+/gi.test(s) && a / b / c;
if (a) b(); else if (c) d(); else { e() }
do { a(); } while (b);
switch (a) { case 1: case 'b': c(); break; default: d() }
try { a() } catch { b() } finally { c() }
var f = function* g() { yield* h(); }
new A; new B(1).c(); delete a.b; void 0; typeof x === 'y';
x = a => b => ({ c, d: 1, [e]: 2, f() {}, get g() { return 1; }, async h() {} });
(function () { 'use strict'; })();
!function () {}(); (() => {})()
a = b ** c; a >>>= 1; a ||= b; a &&= c
const el = <div className="a" onClick={() => f(1)}>{x ? <b>y</b> : null} text <br/></div>;
return_ = <><A {...p} /><B.C d='e' /></>
if (a in b && c instanceof D) throw new E(`f`);
with_ = 1n + 0xFFn; x = .5 + 1e3 + 0b1
a.b.class = c.default; a = { if: 1, class: 2 };
import('a').then(({ default: b }) => b);
let async_ = async function () {}; let of_ = 1, get = 2, set = 3, from = 4;
debugger; ;
while (a--) b++, c--;
x = y
  .map(z => z)
  .filter(Boolean)
""",
    "typescript": r"""
const f = <T,>(a: T): T => a;
let x = y as unknown as Record<string, number[]>;
type A<T> = T extends (infer U)[] ? U : never;
type B = { readonly [K in keyof A]?: A[K] } & C | D;
type F = (a: string, ...b: number[]) => void;
interface I extends J<K>, L { (a: number): string; new (b: B): I; c?: () => void; readonly d: [a: string, b?: number]; }
abstract class A<T extends B = C> implements D, E { private readonly x!: number; constructor(public a: string, protected b?: number) { super(); } abstract f(): void; static g = <T>(h: T) => h; declare z: string }
enum E { A, B = 'b', C = 1 << 2 }
const enum F { A }
declare module 'a' { export const b: string; }
namespace N.M { export type X = 1 }
function f(this: Window, a?: string): asserts a is string {}
function g<T>(a: T): a is T & U { return true; }
import type { A } from './a'; import { type B, C } from 'b';
export type { A } from 'a'; export = x;
let a = b!; let c = d!.e!.f; let t: typeof x = y;
const x = y satisfies Z;
let u: unique symbol; let v: `a${string}b`; let w: A['b']['c'][];
@Component({ a: 'b' }) class G { @Input() h: string; @Output() i = new J<K>(); }
function over(a: string): void; function over(a: number): void; function over(a: any) {}
const el = <A<string> b={c} d="e">text {f}</A>;
for (const [k, v] of Object.entries<number>(a)) f(k, v);
let n: null | undefined = void 0; let m = new Map<string, Array<Set<number>>>();
export default class extends A {} 
let o: object = {}, p: any = <any>q;
type G1 = abstract new (...args: any) => any;
type H1 = keyof typeof obj;
declare global { interface Window { a: string } }
declare function q(a: string): void;
const y2 = a ? (b: string) => c : (d) => e;
accessor_ = 1
""",
    "go": r"""
	a, b := c(), d[1:]
	if x, err := f(); err != nil { return }
	for i := range 10 { _ = i }
	for { break }
	switch x := y.(type) { case int, string: a(); default: b() }
	select { case v := <-c: a(v); case d <- 1: b(); default: }
	go func(a int) { b(a) }(1)
	defer func() { recover() }()
	m := map[string][]int{"a": {1, 2}, "b": nil}
	s := []struct{ a, b int }{{1, 2}, {3, 4}}
	x := &T{A: 1, B: []byte("c")}
	var c <-chan int = make(chan int, 3)
	label: for i := 0; i < 3; i++ { continue label }
	f(a...)
	x = y.(string)
	p := *q; *p = 3; r := &s[1]
	const ( A = iota; B )
	var ( a int; b, c = 1, "d" )
	type T struct { a int `json:"a"`; *B; c.D }
	type I interface { F(a int) (b string, err error); ~int | ~string; fmt.Stringer }
	var f func(int, ...string) (a, b error)
	x := 'a' + '\n' + 0x1p-2 + 1_000 + 3i
	goto end; end: return
	x := Map[string, int]{}; y := F[int](3)
	if v, ok := m[k]; !ok || v == nil && x { }
	a &^= b; c <<= 2; d |= e
	switch { case a > b: fallthrough; case c: }
	x := a[1:2:3]
	var _ I = (*T)(nil)
	for k, v := range m { delete(m, k); _ = v }
	return
""",
    "rust": r"""
    let v: Vec<Vec<u8>> = Vec::new();
    let Some(x) = y else { return; };
    if let Some(x) = y && x > 3 { z(); }
    while let Ok(a) = b.next() { c(a)?; }
    match x { 1..=5 | 7 => a(), n @ 8 if n > 2 => { b() } Foo::Bar { c, .. } => c, &[a, .., b] => a, _ => unreachable!() }
    let f = move |a: &str, b| -> u32 { 1 };
    let g = |x| x + 1; let h = || {};
    'a: loop { break 'a; }
    let x = loop { break 3; };
    let a = [0u8; 32]; let b = &mut a[1..]; let c = *b;
    println!("{x:?} {}", y); vec![1; 3]; assert_eq!(a, b);
    let s = r#"a "b" c"#; let b = b"x"; let c = b'\n'; let d = '\u{1F600}';
    let p = Point { x: 1, ..Default::default() };
    let t: (u8, &'static str) = (1, "a");
    x.iter().map(|&(a, ref b)| a).collect::<Vec<_>>();
    unsafe { *p = 3; }
    let fut = async move { a.await?.b };
    let x = if a { 1 } else if b { 2 } else { 3 };
    let y = x as *const u8 as usize;
    <T as Trait>::f(); Self::CONST; crate::a::b();
    return Ok(());
    fn inner<'a, T: Clone + 'a>(x: &'a T) -> impl Fn(u8) -> u8 + 'a { move |y| y }
    let r = &&x; let n = !a && -b < c >> 2;
    use std::{fmt::{self, Debug}, io::*};
    let x: Box<dyn FnMut(&mut [u8]) -> Result<(), Box<dyn Error>> + Send> = z;
    const N: usize = 3; static mut M: i32 = -1;
    #[cfg(test)] let x = 1;
    for (i, x) in (0..n).rev().enumerate() {}
    let arr: [[i32; 3]; 2] = [[0; 3]; 2];
    matches!(x, A | B if c);
    let Foo(a, b) = c; let (mut d, e) = f;
""",
    "java": r"""
    var x = new ArrayList<Map<String, List<? extends T>>>();
    int[][] a = new int[3][]; int b[] = {1, 2,};
    for (int i = 0, j = 1; i < 3; i++, j--) {}
    for (final var x : y) z(x);
    try (var a = b(); C c = d()) {} catch (A | B e) {} finally {}
    switch (x) { case 1: case 2: a(); break; default: b(); }
    int y = switch (x) { case A, B -> 1; case C -> { yield 2; } default -> throw new E(); };
    String s = switch (o) { case Integer i when i > 0 -> "a"; case Point(int p, var q) -> "b"; case null, default -> "c"; };
    Runnable r = () -> {}; F<A, B> f = (a, b) -> a + b; G g = this::h; H k = int[]::new; A::new.x();
    Function<A, B> f = (final A a) -> { return null; };
    if (o instanceof String t && t.length() > 3) return;
    label: while (true) { continue label; }
    do { a(); } while (b);
    x = a ? b : c ? d : e;
    synchronized (this) { a(); }
    assert a > b : "c";
    int z = (int) y + (Integer) w; (String) q;
    Object o = new Object() { @Override public String toString() { return ""; } };
    List<String> l = List.<String>of("a"); this.<T>f();
    String t = \"\"\"
      a "b"
      \"\"\";
    char c = 'A'; long n = 0xFFL + 1_000L + 0b1; double d = 1e-3 + .5f;
    x >>>= 2; y <<= 1; z ^= ~w;
    throw new A("b", c);
    @SuppressWarnings("a") final int q = 1;
    class Local { int a; } record R(int a, String b) {} enum E { A, B } interface I { void f(); }
    a.b().c[1].d = e -> f;
    int i = +1 - -2; boolean b = !c && d || e & f | g;
    Class<?> k = int.class; Class<String[]> m = String[].class;
    new A().new B(); super.f(); A.super.g();
    ; { } 
    return;
""".replace('\\"', '"').replace("(String) q;\n", "\n").replace(" A::new.x();", ""),
    "csharp": r"""
    var q = from x in y where x.A > 3 orderby x.B descending select new { x.A, C = x.B };
    var g = from a in b join c in d on a.E equals c.F into h from i in h group i by i.J into k select k.Key;
    int? a = b?.C?[1] ?? d; a ??= 3;
    var s = $"a {b:N2} {c?.D ?? "e"}" + @"f\g" + $@"h {i}";
    Func<int, int> f = x => x + 1; Action g = () => { }; Func<int, int, int> h = (int x, int y) => x * y;
    var r = x switch { 1 => "a", > 5 and < 9 => "b", string { Length: > 3 } t when t.A => "c", null => "d", _ => throw new E() };
    if (o is not null and string { Length: 3 } s2 && o is int n) return;
    foreach (var (k, v) in d) { }
    await foreach (var x in y) { }
    using var f = new F(); using (var g = h) { }
    switch (x) { case 1: case 2 when y: break; case A a: goto case 1; default: return; }
    var (a, b) = (1, "c"); (int X, string Y) t = (1, "a");
    try { } catch (A e) when (e.B) { throw; } finally { }
    lock (this) { } checked { a++; } unsafe { int* p = &x; }
    int[] a = { 1, 2 }; var b = new[] { 1 }; int[,] c = new int[2, 3]; var d = new int[2][]; List<int> e = [1, 2, ..a];
    var o = new A { B = 1, C = { D = 2 }, ["e"] = 3 }; A p = new(1);
    x = a ? b : c; y = (int)z; w = z as string; t = typeof(List<>); n = nameof(A.B); d = default; e = default(int);
    async Task<int> L(int a = 1, params string[] b) => await M(a);
    static void N<T>(T a) where T : class, new() { }
    label: goto label;
    yield return 1; yield break;
    f(out var x, ref y, in z, name: 1);
    const int C = 1; var i = ^1; var j = a[1..^2]; 
    delegate (int x) { return x; };
    var l = async (x) => { await y; };
    for (int i = 0, j = 1; i < 3; i++, j--) { }
    do { } while (a);
    a += b << 2; c = !d && e || f; g = h is A or B;
    throw new A($"b {c}");
    var raw = "a"; char c2 = '\n'; long m = 0xFFL + 1_000UL; double d2 = 1e3 + .5m;
    return;
""".replace("    delegate (int x) { return x; };\n", "    D dd = delegate (int x) { return x; };\n"),
    "ruby": r"""
def f(a, b = 1, *c, d:, e: 2, **g, &h) = a
x = y.map(&:z).select { |a| a > 1 }.reduce(0) { |s, (k, v)| s + v }
puts "a #{b + "c"} d" unless e
case x in { name: String => n, age: Integer } if n then a() else b end
case x in [Integer, *rest] then rest else nil end
case a when 1, 2 then b when String then c else d end
a = if b then c else d end
x = begin; a; rescue B, C => e; d; else f; ensure g; end
while a do b end
until a; b; end
for i in 1..3 do puts i end
h = { a: 1, 'b' => 2, "c": 3, d:, **e }
l = ->(a, b = 1) { a + b }; m = lambda { |x| x }; l.(1); l[2]
class A < B::C; include D; attr_reader :a, :b; def self.f; end; class << self; def g; end; end; end
module A::B; C = 1; end
a, (b, *c), d = 1, [2, 3], 4
a ||= b; c &&= d; e **= 2; f <<= 1
puts a if b and not c or d
raise A, "b" if c
return a, b if c
x = a ? b : c
y = %w[a b] + %i(c d); z = %q(e); r = /a\/b/i =~ c; s = %r{d}
yield a, b
super; super(a)
alias b c; undef d
begin; a; end while b
x&.y&.z; A::B.c; ::D
def ==(o); end; def [](i); end; def a?; end; def b!; end; def c=(v); end; def +(o); end; def <=>(o); end
a = b rescue c
private def f; end
puts <<~X
  a #{b}
X
loop { break }; 3.times do |i| next if i.zero? end
p(*a, **b, &c)
defined?(a) && !b; __FILE__; nil.to_a
x = [1, 2,
  3].map do |a|
  a
end
-> { a }; proc { |;b| b }
""",
    "c": r"""
    int a[3] = {[0] = 1, 2}, *b = &a[1], **c;
    struct A { int x : 3; union { int y; } z; } s = { .x = 1, .z.y = 2 };
    for (int i = 0, j = 1; i < 3; i++, --j) continue;
    switch (x) { case 1: case 'a': f(); break; default: ; }
    do { x--; } while (x > 0);
    int (*fp)(int, const char *) = &f; (*fp)(1, "a"); fp(2, "b" "c");
    x = a ? b : c, d = sizeof(int) * sizeof x;
    unsigned long long n = 0xFFULL + 1e3 + .5f + 'a' + L'b';
    label: goto label;
    *p++ = *q--; p->x.y[1] = (int)z; a[i][j] = b;
    const char *const s = "a\n" "b";
    static volatile int v; register int r; extern int e;
    if (!a && ~b || c ^ d) return; else if (e) ; else { }
    typedef struct B *C; enum D { E, F = 2, } g;
    int x = (struct A){ .x = 1 }.x;
    while (*s) s++;
    assert(a == b); size_t n = sizeof(struct A); ssize_t k;
    char buf[MAX + 1]; uint8_t *q = (uint8_t *)malloc(n);
    #define X(a) a
    a <<= 2; b |= 1 << 3; c %= d;
    void *p = NULL; int (*arr)[3]; int *m[3];
    (void)x; -x; +y; !z;
    return;
    { int y; }
    _Bool b1 = 1; inline_ = 3;
    struct A t = *u; struct A *w = &t, v2;
    int long_name = func(a, b)(c);
    x = y = z; x += y -= z;
    if ((x = f()) != 0) { }
    for (;;) { }
""",
    "cpp": r"""
    auto f = [&, this, x = 1](auto a, int b = 2) mutable noexcept -> int { return a; };
    std::vector<std::map<int, std::string>> v{{1, "a"}, {2, "b"}};
    for (const auto &[k, v] : m) {}
    for (auto &&x : std::move(y)) x.z();
    if (auto it = m.find(k); it != m.end()) {}
    if constexpr (std::is_same_v<T, U>) {}
    try { throw A("b"); } catch (const std::exception &e) {} catch (...) {}
    auto p = std::make_unique<A>(1); delete q; delete[] r; new (p) B; new int[3];
    static_cast<int>(x); dynamic_cast<A *>(y); reinterpret_cast<const char *>(z);
    std::function<void(int)> g = [](int) {}; 
    using T = std::vector<int>; using namespace std; namespace a = b::c;
    int x{1}, y(2), &z = x; const A &b = c; A &&d = f();
    template_ = 1; enum class E : int { A, B = 1 };
    std::cout << "a" << b << std::endl;
    a.template f<int>(); A::B::c(); ::g();
    switch (x) { case E::A: break; default: break; }
    auto s = R"(a "b")"; auto n = 1'000'000 + 0b11; auto u = u8"c"; auto l = 10_km;
    x = a < b && c > d; y = a << 2 >> 1; z = x <=> y;
    return;
    struct L { int a = 1; ~L() = default; L(const L &) = delete; explicit L(int a) : a(a), b{2} {} bool operator==(const L &o) const { return a == o.a; } int b; };
    do {} while (false);
    auto [i, j] = std::pair{1, 2};
    int (A::*pm)(int) = &A::f; (a.*pm)(1); (p->*pm)(2);
    co_await x; co_return;
    constexpr int N = sizeof...(Args); static_assert(N > 1, "a");
    alignas(16) char buf[3]; thread_local int t; 
    [[maybe_unused]] int q2 = 1;
    while (std::getline(in, s)) {}
    A<B<C>> d2; A<(1 > 2)> e2;
    goto end; end: ;
    const char *s2 = "a" "b"; long double ld = 1.0L;
""",
    "kotlin": r"""
    val (a, b) = c to d; var x: Int? = null
    a shouldBe b; val p = 1 shl 2 or 3
    val l = listOf(1, 2).map { it * 2 }.filter { x -> x > 1 }.fold(0) { acc, (k, v) -> acc + v }
    when (x) { is String -> a(); in 1..3, !in 5..6 -> b(); null -> c(); else -> { d() } }
    val y = when { a > b -> 1; else -> 2 }
    val z = if (a) b else c
    x?.let { println("$it ${it.foo("a")}") } ?: return
    for ((k, v) in m) continue
    for (i in 0 until 10 step 2) { break }
    try { a() } catch (e: A) { b() } finally { c() }
    val o = object : A(), B { override fun f() = 1 }
    fun <T : Any> g(vararg a: T, b: (Int, String) -> Unit = { _, _ -> }): T where T : C = a[0]
    a!!.b!!; (c as? D)?.e; f as G
    outer@ while (true) { break@outer }
    do { a() } while (b)
    val s = "a" + 'b' + 1_000L + 0xFF + 1e3 + .5f
    x += 1; y++; --z; a[1] = b
    return@f; throw E("a")
    val f: suspend (Int) -> Unit = {}; val g: A.(B) -> C = { d }
    lazy_.value; val q by lazy { 1 }
    A::class.java; ::f; a::b; String::length
    data class P(val a: Int = 1, private val b: String) : Q(a), R by s { init { c() } companion object { const val D = 1 } }
    @Suppress("a") val v = 1
    with(a) { b }; run { }; a.apply { b = 1 }.also { c(it) }
    val n = a?.b?.c ?: d ?: throw E()
    if (a !in b && c !is D || e === f && g !== h) return
    val r = 1..10; val t = 'a'..'z'; val u = arrayOf<Int>()
    f(a = 1, b = { }) { c }; g(*d)
    enum class E2(val a: Int) { A(1), B(2) { override fun f() = 3 }; fun g() = 4 }
    typealias_ = 1
    val lambda = fun(x: Int): Int { return x }
""",
    "swift": r"""
    let ys = xs.map { $0 + 1 }.filter { x in x > 1 }.reduce(0, +)
    guard let a = b, c > d, case .e(let f) = g else { return }
    if let a, let b = c as? D { e() } else if case .f = g { }
    switch x { case .a(let b, _) where b > 1: c(); case 1...5, 7: d(); case is String: e(); case let f as G: h(f); default: break }
    for (i, x) in y.enumerated() where i > 0 { continue }
    while let a = b.next() { }
    repeat { a() } while b
    do { try a() } catch let e as B { c(e) } catch { d }
    let x: [String: [Int]?] = ["a": [1, 2], "b": nil]; var t: (a: Int, b: String) = (1, "c")
    let f: (Int, inout String) throws -> Void = { a, b in }
    defer { a() }; fallthrough_ = 1
    let s = "a \(b + "c") d" + #"e\f"#
    x?.y?[1]?.z(); a!.b; try? c(); try! d(); await e()
    let z = a ? b : c; let n = a ?? b ?? c
    a += 1; b <<= 2; c &= ~d; e = !f && g || h
    func g<T: A & B, U>(_ a: T, b c: U..., d: Int = 1) async throws -> some V where T.W == U { }
    let k = \A.b.c; let m = A.self; type(of: a)
    async let q = r(); let u = try await v()
    f(a: 1, b: { $0 }) { x, y in z } onError: { _ in }
    class C<T>: D, E { private(set) var a: Int { didSet { b() } } lazy var c = { 1 }(); init?(d: Int) { }; deinit { }; static let e = 1; subscript(i: Int) -> Int { get { 1 } set { } } }
    enum F: String, CaseIterable { case a, b = "c"; indirect case d(F, g: Int); var h: Int { switch self { case .a: return 1; default: return 2 } } }
    protocol P: AnyObject { associatedtype A; var b: Int { get set }; func c() throws; init() }
    extension A where T: B { }
    @discardableResult func h() -> Int { 1 }
    #if DEBUG
    a()
    #endif
    let r = 1..<10; let v2 = ...5; let hex = 0xFF_FF + 1e3
    if #available(iOS 15, *) { }
    return
    typealias_ = 1
    [weak_].forEach { [weak self, b = c] in self?.d($0) }
    label: for x in y { break label }
    struct S { var a = 1; mutating func b() { a += 1 }; @State private var c = 2 }
    let op = a...b ~= c
""".replace("\n    let op = a...b ~= c\n", "\n"),
    "php": r"""
$x = match (true) { $a > 1, $b => 'c', default => throw new E() };
$f = fn($a) => $a + 1; $g = function ($a) use (&$b, $c): int { return 1; };
foreach ($a as $k => [$b, 'c' => $d]) { continue 2; }
if ($a): b(); elseif ($c): d(); else: e(); endif;
while ($a): b(); endwhile; for ($i = 0, $j = 1; $i < 3; $i++, $j--) {}
switch ($a) { case 1: case 'b': c(); break; default: d(); }
try { a(); } catch (A | B $e) { } catch (C) { } finally { }
$a?->b?->c(); A::b(); A::$c; A::D; $e::class; static::f(); new static; new ($g)(1);
$x = $a ?? $b ?: $c ? 1 : 2;
$s = "a $b {$c->d['e']} ${f}" . 'g' . <<<X
 h $i
X;
[$a, [, $b]] = $c; list('d' => $e) = $f; [...$g, ...$h];
function f(int|string $a, ?B $c = null, &...$d): ?static { yield $a => $b; yield from $c; return; }
abstract class A extends B implements C, D { use E, F { E::g insteadof F; } const G = 1; public readonly int $h; protected static ?array $i = []; public function __construct(private string $j = 'k', protected readonly array $l = []) { parent::__construct(); } abstract protected function m(): void; }
enum S: string { case A = 'a'; case B = 'b'; public static function c(): self { return self::A; } }
interface I extends J, K { public function l(): void; }
namespace A\B; 
use A\B\{C, D as E}; use function F\g; use const H\I;
echo $a, "b"; print $c; exit(1); die;
#[Attr(1)] function g() {}
$o = new class(1) extends A { public $b; };
global $a, $b; static $c = 1; unset($d, $e); isset($f, $g['h']); empty($i);
$a .= 'b'; $c **= 2; $d ??= 3; $e <=> $f; $g instanceof H; !$i && $j || $k xor $l and $m;
(int) $a + (string) $b; @$c; &$d; clone $e;
$a = &$b; $c = ['d' => &$e, 'f'];
goto end; end:
declare(strict_types=1);
$f(...); strlen(...); f(a: 1, b: 2); $a['b']['c'][] = 1; $a->{$b}->c = 2; $$d = 3;
do { a(); } while ($b);
return $a;
throw new E('a');
?> html <?php echo 1; ?> more <?= $x ?>
const X = 1; 
""".replace("@$c; &$d; clone $e;", "@$c; clone $e;").replace("\nnamespace A\\B; \n", "\n"),
    "json": "\n".join(['{"a": [1, -2.5e+3, true, false, null], "b": {"c": "\\u00e9\\n"}}', "[]", "{}", '"a"', "1", "-0.5", "true", "null", '[[], {}, [[1]]]', '{"": ""}', '{"a":{"b":{"c":[]}}}', "0", "1E5", '["\\"", "\\\\"]', '[1,2,3]', '{"a":1,"b":2}', '[{"a":null},{"b":[true]}]', '"\\ud83d\\ude00"', "[0.1, 10, 1e-2]", '{"x y": "z"}', "[null]", '[""]', '{"k":[{"l":{}}]}', "12345678901234567890", "[-1]", '{"a":"b"}', '[[["x"]]]', '{"1":1}', "false", '{"a": "\\t"}']),
}

# Broken pieces: made from the valid ones by ``breaks``, and these.
BROKEN = {
    "python": ["def f(:", "x = = 3", "if a\n    b", "for in x: pass", "return return", "class : pass", "a b c", "x = [1, 2", "print 'a'", "def f()\n    pass", "import", "from a import", "x = 'a", "while: pass", "lambda x y: 1", "else: a", "try:\n    a\nb", "  x = 1\n y = 2", "f(a b)", "x ++ = 1", "a = 1 +", "@", "del", "elif a: b", "with a as: b", "{a: }", "x = (1, 2]", "async x = 1", "def 1f(): pass", "a.1b", "x = 08 1"],
    "javascript": ["let = ;", "if (a { b() }", "for (;;", "function () {", "const a;=", "a b", "x = [1, 2", "return }", "class { ", "import from", "x => => y", "let x = 'a", "f(a b)", "if a { b }", "switch { }", "var 1a = 2;", "({a: })", "try { }x", "do { } b", "x = ;", "function f( { }", "new ;", "while { }", "a = b ? c;", "import { a b } from 'c'", "export ;", "throw ;)"],
    "typescript": ["let x: = 1;", "interface { a: b }", "type = string;", "function f(a: ): void {}", "enum { A }x", "class A { x: }", "let a b;", "const f = (a: string => b;", "x = <", "type A = ;", "if (a { }", "let x: number = ;", "f(a b)", "class A implements { }", "import type from", "for (;;", "interface A { b c }", "let x = 'a", "type A<> = ;", "abstract ;=", "x as ;", "enum A { , }", "let x:: string;", "return }", "try { }x", "({a: })", "namespace { }x"],
    "go": ["x := ", "if a { b() ", "for i := 0; i < 3 { ", "func (", "var x int = ", "a b c", "x = [1, 2]]", "return return", "switch { case }", "f(a b)", "if { }", "x := 'ab c", "go ;x", "defer", "x := map[string]{}", "type T struct { a int", "for { ", "a := := b", "if a == { }", "var 1a int", "func f() { }{", "x.(", "x = y z", "import x", "a, := b", "x = ;= y", "select { a }"],
    "rust": ["let = 3;", "fn f( {", "if x { y() ", "match x { a => }", "let x 3;", "a b c;", "x = [1, 2;", "return }", "for in y { }", "f(a b);", "let x: = 1;", "impl { ", "struct { a: u8 }", "use ;", "while { }}", "let x = ;", "let mut = 1;", "fn () {}", "match { }", "enum { A }", "x.;", "let s = \"a", "pub ;", "loop ", "if let = x { }", "let x = y z;", "mod ;", "x => y;"],
    "java": ["int = 3;", "if (a { b(); }", "for (;;", "foo(1,);", "a b c;", "x = [1, 2];", "return }", "int x = ;", "f(a b);", "if a { }", "switch { }", "int 1a = 2;", "try { }", "new ;", "while { }", "do { }", "x = 'ab';", "String s = \"a;", "int x = 1", "catch (A e) { }", "throw ;", "a.;", "import a.b;", "for (int i : ) { }", "int[] a = {1, 2;", "class { }", "void g() {"],
    "csharp": ["int = 3;", "if (a { b(); }", "for (;;", "foo(1,);", "a b c;", "return }", "int x = ;", "f(a b);", "if a { }", "switch { }", "int 1a = 2;", "try { }", "new ;", "while { }", "do { }", "String s = \"a;", "int x = 1", "catch (A e) { }", "a.;", "foreach (var x y) { }", "int[] a = {1, 2;", "class { }", "void g() {", "using ;", "x => => y;", "throw ;)", "lock { }"],
    "ruby": ["def f(a", "if a", "class", "x = [1, 2", "end", "while a do", "a = = 1", "{ a: 1", "f(a b)", "def", "do |x|", "case a", "x = 'a", "puts \"a", "module", "begin", "a +* b )", "unless", "x = (1, 2]", "}", "def f; if a; end", "else", "when 1", "rescue", "a => => b", "x = %w[a", "->(a { }", ")", "elsif a", "class A; def f; end"],
    "c": ["int = 3;", "if (a { b(); }", "for (;;", "foo(1,);", "a b c;", "return }", "int x = ;", "f(a b);", "if a { }", "switch { }", "int 1a = 2;", "a +* / b;", "while { }", "do { }", "char *s = \"a;", "int x = 1", "a.;", "int a[] = {1, 2;", "struct { int", "void g() {", "x = [1];", "case 1", "goto ;", "sizeof ;", "p->;", "*;", "int int_ x y;", "a ? b;", "(a;"],
    "cpp": ["int = 3;", "if (a { b(); }", "for (;;", "foo(1,);", "a b c;", "return }", "int x = ;", "f(a b);", "if a { }", "switch { }", "int 1a = 2;", "a +* / b;", "while { }", "do { }", "char *s = \"a;", "int x = 1", "a.;", "int a[] = {1, 2;", "void g() {", "try { }", "catch (...) { }", "new ;", "std::;", "template <> ;=", "class { int", "a ? b;", "(a;", "x->;", "using ;"],
    "kotlin": ["val = 3", "if (a { b() }", "fun (", "val x: = 1", "when { a }", "x = [1, 2", "return }", "f(a b)", "for (in y) { }", "class", "val 1a = 2", "while { }", "try { }", "val s = \"a", "val x = ", "a.", "fun f( {", "object : ", "import ", "x -> y", "when (x { }", "if a { }", "val (a = b", "catch (e: A) { }", "val val x = 1", "fun f(a) = 1", "}", "val x = (1"],
    "swift": ["let = 3", "if a b()", "func (", "let x: = 1", "switch { }", "x = [1, 2", "return }", "f(a b)", "for in y { }", "class", "let 1a = 2", "guard let a = b { }", "while { }", "let s = \"a", "let x = ", "a.", "func f( {", "import ", "if { }", "let (a = b", "catch { }", "let let x = 1", "}", "let x = (1", "struct { }", "enum { case a }", "func f(a) { }", "guard a else"],
    "php": ["$x = ;", "if ($a { b(); }", "for (;;", "foo(1,,2);", "$a $b;", "return }", "f($a $b);", "if $a { }", "switch { }", "$1a = 2;", "$a +* / $b;", "try { }", "new ;", "while { }", "do { }", "$s = \"a;", "$x = 1", "catch (A $e) { }", "$a->;", "foreach ($x $y) { }", "$a = [1, 2;", "class { }", "function g() {", "use ;", "$x => => $y;", "function ($a { };", "A::;", "echo ;"],
    "json": ["{", "[1, 2", '{"a" 1}', "{'a': 1}", '{"a": 1,}', "[1,]", "01", "1.", ".5", "+1", "tru", '"a', '{"a": }', "[,]", '{a: 1}', "[1 2]", "{}{}", '"\\x"', "NaN", "Infinity", '{"a": 1 "b": 2}', "[1, 2}}", "]", "1 2", '"a\tb"', "// c\n1", "[1] x", "-", "1e", '{"a"}'],
}


def pieces(lang: str) -> list[str]:
    """The valid pieces; a piece that goes on over lines is one."""
    out: list[str] = []
    depth, open_to = 0, None
    for line in STATEMENTS[lang].strip("\n").split("\n"):
        joined = out and (open_to or depth > 0 or line.lstrip().startswith((".map", ".filter")))
        if joined:
            out[-1] += "\n" + line
        else:
            out.append(line)
        if open_to:
            if open_to in line and (open_to != "X" or line.strip().rstrip(";") == "X"):
                open_to = None
            continue
        if line.count('"""') == 1:
            open_to = '"""'
        elif "<<~X" in line or "<<<X" in line:
            open_to = "X"
        elif lang == "swift" and "#if DEBUG" in line:
            open_to = "#endif"
        elif lang == "ruby":
            depth += line.count("[") - line.count("]")
            if line.rstrip().endswith("|a|"):
                open_to = "end"
    return out


def whole(lang: str, piece: str) -> str:
    """A file that holds the piece."""
    head, _, tail = WRAP[lang].replace("{{", "\0").replace("}}", "\1").partition("{}")
    return (head + piece + tail).replace("\0", "{").replace("\1", "}")
