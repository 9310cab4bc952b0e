"""Small sources with what is to be found in them, by hand: units with their lines, trees of node types, prompts and their contexts.

`~` stands for the id of the row that a template is made for.
"""

from __future__ import annotations

# (language, extension, code, units as (kind, qualified name, first line, last line))
FILES = [
    (
        "C", ".cpp",
        "namespace Geo {\n// a shape\nclass Shape~ {\npublic:\n    int area() { return 1; }\n};\n}\n\ntemplate <typename T>\nclass Cell~ {\npublic:\n    T value;\n};\n\n"
        "template <typename T>\ninline T sum~(T a, T b) {\n    return a + b;\n}\n",
        [("type", "Geo::Shape~", 2, 6), ("method", "Geo::Shape~::area", 5, 5), ("type", "Cell~", 9, 13), ("function", "sum~", 15, 18)],
    ),
    (
        "C", ".h",
        "#define LIMIT_~ 10\ntypedef unsigned int word_~;\nstruct Point_~ { int x; int y; };\nenum Color_~ {\n    RED_~,\n    BLUE_~\n};\nunion Both_~ {\n    int i;\n    float f;\n};\n"
        "extern int a_~, *b_~;\nstruct Later_~;\nint f_~(void);\n",
        [
            ("global", "global::LIMIT_~", 1, 1), ("global", "global::word_~", 2, 2), ("type", "Point_~", 3, 3), ("type", "Color_~", 4, 7), ("type", "Both_~", 8, 11),
            ("global", "global::a_~,b_~", 12, 12), ("global", "global::f_~", 14, 14),
        ],
    ),
    (
        "Java", ".java",
        "package p;\n\n/** A holder. */\nclass Holder_~ {\n    private int x_~ = 1, y_~;\n\n    Holder_~() {}\n\n    @Override\n    public String toString() {\n        int a = 1;\n"
        "        int b = 2;\n        return null;\n    }\n\n    static class Inner_~ {}\n}\n\nenum Tint_~ {\n    RED,\n    BLUE;\n\n    public String show() {\n        return name();\n    }\n}\n\n"
        "interface Order_~ {\n    int compare(Object o);\n    default boolean same(Object o) {\n        return compare(o) == 0;\n    }\n}\n",
        [
            ("type", "Holder_~", 3, 17), ("global", "Holder_~::global::x_~,y_~", 5, 5), ("method", "Holder_~::Holder_~", 7, 7), ("method", "Holder_~::toString", 9, 14),
            ("declaration_block", "Holder_~::toString::declblock#1", 11, 12), ("type", "Holder_~::Inner_~", 16, 16), ("type", "Tint_~", 19, 26), ("method", "Tint_~::show", 23, 25),
            ("type", "Order_~", 28, 33), ("method", "Order_~::compare", 29, 29), ("method", "Order_~::same", 30, 32),
        ],
    ),
    (
        "C", ".hpp",
        "local unsigned int crc_~ OF((unsigned int *m,\n                             unsigned int v));\nclass API_~ IAlloc_~ : public IBase\n{\npublic:\n"
        "    virtual int Take (unsigned n, void** out) = 0;\n};\nMIDL_INTERFACE(\"AB-~\")\nIOut_~ : public IBase\n{\n};\n",
        [("global", "global::crc_~", 1, 2), ("type", "IAlloc_~", 3, 7), ("type", "IOut_~", 9, 11)],
    ),
    (
        "C", ".cc",
        "int braces_~(int x) {\n    const char *q = \"}{\";\n    char c = '{'; // }\n    /* } */\n    return x + c + q[0];\n}\nstruct Tail_~ {\n    int a;\n} /* end */\n;\nnamespace A_~::B {\nvoid go() { return; }\n}\n"
        "static int lost_~( {\n    return 1;\n}\nint kept_~(int b) {\n    return b;\n}\n",
        [("function", "braces_~", 1, 6), ("declaration_block", "braces_~::declblock#1", 2, 3), ("type", "Tail_~", 7, 10), ("function", "A_~::B::go", 12, 12), ("function", "lost_~", 14, 16), ("function", "kept_~", 17, 19)],
    ),
]


def _t(kind: str, *children) -> tuple:
    return kind, [c if isinstance(c, tuple) else (c, []) for c in children]


_PLAIN = _t("declaration", "primitive_type", "identifier", ";")
_RETURN = _t("return_statement", "return", "identifier", ";")
# (language, code, tree of node types)
TREES = [
    ("C", "int x~;", _t("translation_unit", _PLAIN)),
    ("C", "int x~ = 1;", _t("translation_unit", _t("declaration", "primitive_type", "identifier", "=", "number_literal", ";"))),
    (
        "C", "/* f */ int f~(int a) {\n    return a;\n}\n",
        _t("translation_unit", _t("function_definition", "primitive_type", _t("function_declarator", "identifier", _t("parameter_list", "(", "primitive_type", "identifier", ")")), _t("compound_statement", "{", _RETURN, "}"))),
    ),
    ("C", "struct P~ {\n    int x; // x\n};\n", _t("translation_unit", _t("struct_specifier", "struct", "identifier", _t("field_declaration_list", "{", _t("field_declaration", "primitive_type", "identifier", ";"), "}")), ";")),
    ("Java", "class A~ {\n    int x;\n}\n", _t("program", _t("class_declaration", "class", "identifier", _t("class_body", "{", _t("field_declaration", "primitive_type", "identifier", ";"), "}")))),
    ("C", "return x~;", _t("translation_unit", _RETURN)),
    ("C", "int x~;\nint y~;\n", _t("translation_unit", _PLAIN, _PLAIN)),
]

_TEN = "".join(f"x{i} = {i};\n" for i in range(1, 11))
# (builder, prompt, context, mode, whether a comment was found, kind, local lines)
PROMPTS = [
    ("strict", "// note ~\nstatic int f_~(int a)\n{\n    int b = a;\n    return ", "// note ~\n\nstatic int f_~(int a)\n{\n    int b = a;\n    return ", "strict", True, "function_signature", 0),
    ("strict", "int old_~;\nstruct P_~ {\n    int x;\n    int ", "struct P_~ {\n    int x;\n    int ", "strict", False, "type_declaration", 0),
    ("strict", _TEN, "x4 = 4;\nx5 = 5;\nx6 = 6;\nx7 = 7;\nx8 = 8;\nx9 = 9;\nx10 = 10;\n", "strict", False, "local_scope", 0),
    ("plus_local8", "/* top ~ */\nint z;\nint g_~(int a,\n        int b)\n{\n    a += b;\n    b += a;\n", "/* top ~ */\nint z;\nint g_~(int a,\n        int b)\n{\n    a += b;\n    b += a;\n", "plus_local8", True, "function_signature", 8),
    ("plus_local8", "int h_~(int a)\n{\n" + _TEN, "int h_~(int a)\n{\n" + _TEN, "plus_local8", False, "function_signature", 8),
    ("strict", " \n", " \n", "strict_empty", False, "empty", 0),
    ("plus_local16", "#include <a.h>\r\n// one\r\n// two ~\r\nif (x~) {", "#include <a.h>\n// one\n// two ~\nif (x~) {", "plus_local16", False, "local_scope", 16),
]
