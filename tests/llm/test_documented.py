"""Functions and their documentation: bodies, long signatures, disabled code."""

from siftspark.llm import documented as d

PY = """import os

@cache
def f(
    a: int,
    b: str = ")",

    c: list[int] = [1, 2],


    e=None,
    g=None,
) -> int:

    '''Counts the entries that are left.'''
    return a

    # done

x = f(1)
"""
JS = """// Above it.
function go(a,
            b)
{

  /* Walks the list from its end. { */
  if (a) { return "}"; }
  return b;
}
const after = 1;
"""
RB = """def each(a)
  a.each do |x|
    puts x if x
  end
end
after = 1
"""


def test_bodies():
    assert d.code_of(PY).startswith("def f(") and d.code_of(PY).endswith("# done")
    assert d.code_of(JS).endswith("return b;\n}") and d.code_of(JS).startswith("function go")
    assert d.code_of(RB).endswith("\nend") and "after" not in d.code_of(RB)
    assert d.code_of(None) is None and d.code_of("x = 1") == "x = 1" and d.code_of("int f(int a);\nint g;") == "int f(int a);"


def test_documentation_behind_a_long_signature():
    assert d.tells(d.attached(None, PY), "f") == "Counts the entries that are left."
    assert "Walks the list" in d.tells(d.attached(None, JS), "go")
    assert d.tells(d.attached(None, "def f(a):" + "\n" * 40 + "    \"\"\"Gives the newest one back.\"\"\"\n    return a"), "f")


def test_disabled_code_tells_nothing():
    for text in ("window = encode_spare_symbol(window, 2)", "frame = flush_remote_old_big_ticket(frame, 7)", "return a_b_c_d_e_f(x)"):
        assert d.tells(text, "f") == "", text
    assert d.tells("Returns x = 1 when the list of entries is empty", "f")


def test_pairs_hold_the_function_alone(spark):
    df = spark.createDataFrame([(1, "function", "f", PY, None, 9), (2, "method", "go", JS, "", 9), (1, "function", "f", PY, None, 9)], "chunk_id long, kind string, symbol_name string, excerpt string, doc string, code int")
    got = {r.chunk_id: r.code for r in d.pairs(df).collect()}
    assert got == {1: d.code_of(PY), 2: d.code_of(JS)}
