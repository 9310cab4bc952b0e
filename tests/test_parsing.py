"""Semantic units, structure fingerprints and bracket checks on small sources."""

from hashlib import md5

import pytest

from codeloom.parsing import Node, structure_fingerprint, units_of
from codeloom.parsing.outline import is_valid
from codeloom.parsing.structure import ZERO, fold


def by_name(code, language="C", **kw):
    return {u.qualified_name: u for u in units_of(code, language, **kw)}


def test_type_global_function_with_comment():
    units = units_of("#include <a.h>\n/* a pair */\nstruct Pair {\n    int left;\n};\n\nint total = 1;\n\nint add(int a) {\n    return a + total;\n}\n", "C")
    assert [u.kind for u in units] == ["type", "global", "function"]
    assert units[0].qualified_name == "Pair" and (units[0].start_line, units[0].end_line) == (2, 5)
    assert units[0].text.startswith("/* a pair */\nstruct Pair") and units[0].text.endswith("};")
    assert units[1].qualified_name == "global::total" and units[2].qualified_name == "add"


def test_boundaries_are_trimmed_and_indentation_kept():
    unit = by_name("\n\n   #include <a.h>\n\nint run() {\n    return 0;\n}   \n\n")["run"]
    assert unit.text == "int run() {\n    return 0;\n}" and (unit.start_line, unit.end_line) == (5, 7)


def test_min_lines_drops_single_lines():
    code = "int total = 1;\n\nint run() {\n    return total;\n}\n"
    assert [u.kind for u in units_of(code, "C")] == ["global", "function"]
    assert [u.kind for u in units_of(code, "C", min_lines=1)] == ["function"]


def test_namespaces_classes_methods():
    units = by_name("namespace Geo {\nclass Shape {\npublic:\n    int area() { return 1; }\n};\n}\n")
    assert {"Geo::Shape", "Geo::Shape::area"} <= set(units) and units["Geo::Shape::area"].parent_qualified_name == "Geo::Shape"
    assert units["Geo::Shape::area"].kind == "method"
    assert by_name("namespace P::Q::R {\nvoid go() { return; }\n}\n")["P::Q::R::go"].parent_qualified_name == "P::Q::R"


def test_templates_keep_their_prefix():
    units = by_name("template <typename T>\nclass Cell {\npublic:\n    T value;\n};\n\ntemplate <typename T>\ninline T sum(T a, T b) {\n    return a + b;\n}\n")
    assert units["Cell"].text.startswith("template <typename T>\nclass Cell") and units["sum"].text.startswith("template <typename T>\ninline T sum")


@pytest.mark.parametrize(
    ("code", "name"),
    [
        ("class API_PUBLIC IAllocator : public IBase\n{\npublic:\n    virtual int Take (unsigned n, void** out) = 0;\n};\n", "IAllocator"),
        ('MIDL_INTERFACE("AB-12")\nIOutput : public IBase\n{\npublic:\n    virtual int STDCALL Supports(\n        Mode mode) = 0;\n};\n', "IOutput"),
        ('template<>\nclass LIB_EXPORTS Crop<ns::Cloud> : public Filter<ns::Cloud>\n{\npublic:\n  Crop (bool keep = false) :\n    Filter<ns::Cloud>::Filter (keep)\n  {\n    name_ = "Crop";\n  }\n};\n', "Crop"),
    ],
)
def test_types_behind_macros(code, name):
    units = units_of(code, "C")
    unit = next(u for u in units if u.kind == "type")
    assert unit.qualified_name == name and unit.text.endswith("};")
    assert not any(u.kind == "function" for u in units) and not any(u.symbol_name in ("IBase", "LIB_EXPORTS") for u in units)


def test_labelled_type_starts_at_its_name():
    assert units_of('MIDL_INTERFACE("AB")\nIOut : public IBase\n{\n};\n', "C")[0].text.startswith("IOut : public IBase")


def test_tails_give_nothing():
    assert units_of('#endif\n\n} // a\n\n//! @} x\n\n} // b\n\n#include "c.hpp"\n\n#endif //END\n', "C") == []
    assert units_of("", "C") == units_of(" \n", "C") == units_of("x", "Perl") == []


def test_macro_prototypes_keep_their_names():
    units = units_of("/* sums */\nlocal unsigned int crc_times OF((unsigned int *m,\n                               unsigned int v));\nlocal void crc_square OF((unsigned int *s, unsigned int *m));\n", "C")
    assert [u.qualified_name for u in units] == ["global::crc_times", "global::crc_square"]
    assert units[1].text.endswith("unsigned int *m));")


def test_stray_loops_and_odd_declarations():
    assert not any(u.kind == "global" for u in units_of("return 0;\n}\nif(x[y].empty ()){\n  f(x);\n  return 0;\n}\nfor(std::size_t p = 0; p < x[y].size(); p++){\n  float best = 1;\n  int id = NONE;\n}\n", "C"))
    assert any(u.kind == "global" and u.symbol_name == "int" for u in units_of("EXPORT int;\n", "C"))


def test_java_types_and_methods():
    assert {"A", "A::A", "A::f", "A::B"} <= set(by_name("package p;\nclass A {\n    A() {}\n    void f() {}\n    static class B {}\n}\n", "Java"))
    assert {"Color", "Color::show"} <= set(by_name("enum Color {\n    RED,\n    BLUE;\n\n    public String show() {\n        return name();\n    }\n}\n", "Java"))
    units = by_name("interface Order {\n    int compare(Object o);\n    default boolean same(Object o) {\n        return compare(o) == 0;\n    }\n}\n", "Java")
    assert {"Order", "Order::compare", "Order::same"} <= set(units)
    units = by_name("class A {\n  private int x = 1, y;\n  @Override\n  public String toString() { int a = 1;\n    int b = 2;\n    return null; }\n}\n", "Java")
    assert {"A::global::x,y", "A::toString", "A::toString::declblock#1"} <= set(units)


def test_declaration_blocks():
    block = by_name("int f(int v) {\n    int x = v;\n    // more\n    int y = x + 1;\n    return y;\n}\n")["f::declblock#1"]
    assert block.text == "    int x = v;\n    // more\n    int y = x + 1;" and (block.start_line, block.end_line) == (2, 4)
    assert not any(u.kind == "declaration_block" for u in units_of("int f() {\n    int v = 1;\n    return v;\n}\n", "C"))
    assert not any(u.kind in ("declaration_block", "global") for u in units_of("class A {\npublic:\n    int x;\n    using P = ptr<A>;\n    typedef int I;\n    void f() override;\n    bool operator==(const A& o) const;\n    A();\n    ~A();\n};\n", "C"))
    names = [u.symbol_name for u in units_of("void f() {\n  int a;\n  int b;\n  g();\n  int c;\n  g();\n  int d;\n  int e;\n}\n", "C") if u.kind == "declaration_block"]
    assert names == ["declblock#1", "declblock#3"]


def test_class_with_constructor_list():
    units = by_name("class V {\npublic:\n    int x;\n    V(int x, int y) : x(x), y{y} {}\n    int dot(const V& o) { return x*o.x; }\n};\n")
    assert {"V", "V::V", "V::dot"} == set(units)


def test_globals():
    units = set(by_name("#define LIMIT 10\n#define MAX(a, b) \\\n  ((a) > (b))\ntypedef unsigned int word;\nusing Name = std::string;\nextern int a, *b;\nint (*handler)(int);\nstruct P;\nstruct Q { int z; } q;\nint f(void);\nMACRO(x);\n"))
    assert {"global::LIMIT", "global::MAX", "global::word", "global::Name", "global::a,b", "global::handler", "global::q", "Q", "global::f"} == units


def test_broken_code():
    code = "static int oops( {\n  int a = 1;\n  int b = 2;\n  return a;\n}\nint next(int b) {\n  return b;\n}\n"
    assert [(u.kind, u.qualified_name, u.start_line, u.end_line) for u in units_of(code, "C")] == [("function", "oops", 1, 5), ("declaration_block", "oops::declblock#1", 2, 3), ("function", "next", 6, 8)]
    assert not is_valid(code, "C") and [u.kind for u in units_of("int x({1, 2});\nstd::vector<int> y({3});\n", "C")] == ["global", "global"]
    assert is_valid("int f() { return 0; }", "C") and not is_valid("int f( { return 0; }", "C") and is_valid("(", "Perl")


def test_structure_fold():
    h = lambda s: md5(s.encode()).hexdigest()
    leaf = lambda t: h("0" + h(t))
    n = lambda t, *c: Node(t, 0, 0, list(c))
    tree = n("root", n("x"), n("comment"), n("pair", n("y"), n("z")))
    pair = h(h("0" + leaf("y")) + leaf("z"))
    assert fold(tree) == [leaf("x")[:16], leaf("y")[:16], leaf("z")[:16], pair[:16], h(h("0" + leaf("x")) + pair)[:16]]
    assert fold(n("root", n("comment"))) == [ZERO] and fold(n("comment")) == []


def test_identifiers_are_abstracted():
    a = structure_fingerprint("int f(int x) { int acc = x + 1; return acc; }", "C")
    assert a == structure_fingerprint("int g(int y) { int total = y + 1; return total; }", "C")
    assert a != structure_fingerprint("int g(int y) { int total = y - 1; return total; }", "C")
    assert structure_fingerprint("", "C") and structure_fingerprint(None, "C") is None and structure_fingerprint("x", "Perl") is None


def test_nested_units_are_folded_once(monkeypatch):
    """The tree below a type is folded with it: its methods' fingerprints are stretches of its own, not folded anew."""
    from codeloom.operators import ingest
    from codeloom.parsing import structure

    code = "class A {\n" + "".join(f"  class B{i} {{\n    int f{i}() {{ return {i}; }}\n  }}\n" for i in range(20)) + "}\n"
    units = [u for u in units_of(code, "Java") if u.node is not None]
    assert len(units) == 41
    runs, plain = [], structure._fold
    monkeypatch.setattr(structure, "_fold", lambda root, held: runs.append(root) or plain(root, held))
    rows = ingest._rows_of({"repository": "r", "relative_path": "A.java", "file_extension": ".java", "language": "Java", "content": code}, 0)
    assert len(runs) == 1
    assert sorted(r[12] for r in rows) == sorted(structure.fold(u.node) for u in units)
