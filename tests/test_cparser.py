"""The parser on small sources: node names, fields, ambiguities, recovery."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrygraph.functions.cparser import parse, s_expression
from quarrygraph.operators.cst import node_rows


def tree(source: str) -> str:
    return s_expression(parse(source.encode()), fields=False)


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("int a;", "(translation_unit (declaration (primitive_type) (identifier)))"),
        ("a * b;", "(translation_unit (declaration (type_identifier) (pointer_declarator (identifier))))"),
        ("f(x);", "(translation_unit (expression_statement (call_expression (identifier) (argument_list (identifier)))))"),
        ("x = (T *)y;", "(translation_unit (expression_statement (assignment_expression (identifier) (cast_expression (type_descriptor (type_identifier) (abstract_pointer_declarator)) (identifier)))))"),
        ("x = (a * b);", "(translation_unit (expression_statement (assignment_expression (identifier) (parenthesized_expression (binary_expression (identifier) (identifier))))))"),
        ("x = a + b * c;", "(translation_unit (expression_statement (assignment_expression (identifier) (binary_expression (identifier) (binary_expression (identifier) (identifier))))))"),
        ("typedef struct A { int i; } B;", "(translation_unit (type_definition (struct_specifier (type_identifier) (field_declaration_list (field_declaration (primitive_type) (field_identifier)))) (type_identifier)))"),
        ("void (*f)(int);", "(translation_unit (declaration (primitive_type) (function_declarator (parenthesized_declarator (pointer_declarator (identifier))) (parameter_list (parameter_declaration (primitive_type))))))"),
        ("#define A 1\n#ifdef B\nint c;\n#else\nint d;\n#endif\n", "(translation_unit (preproc_def (identifier) (preproc_arg)) (preproc_ifdef (identifier) (declaration (primitive_type) (identifier)) (preproc_else (declaration (primitive_type) (identifier)))))"),
        ("#include <a.h>\n", "(translation_unit (preproc_include (system_lib_string)))"),
        ("int f() { return /* c */ x; }", "(translation_unit (function_definition (primitive_type) (function_declarator (identifier) (parameter_list)) (compound_statement (return_statement (comment) (identifier)))))"),
        ("l: for (int i = 0; i < 3; i++) break;", "(translation_unit (labeled_statement (statement_identifier) (for_statement (declaration (primitive_type) (init_declarator (identifier) (number_literal))) (binary_expression (identifier) (number_literal)) (update_expression (identifier)) (break_statement))))"),
        ("", "(translation_unit)"),
    ],
)
def test_trees(source, expected):
    assert tree(source) == expected


def test_fields():
    assert s_expression(parse(b"p->x = 1;")) == "(translation_unit (expression_statement (assignment_expression left: (field_expression argument: (identifier) field: (field_identifier)) right: (number_literal))))"


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("int f(a, b) int a; char *b; { return a; }", "(function_definition (primitive_type) (function_declarator (identifier) (parameter_list (parameter_declaration (type_identifier)) (parameter_declaration (type_identifier)))) (ERROR) (compound_statement (return_statement (identifier))))"),
        ("int x __attribute__((unused)) = 1, y;", "(declaration (primitive_type) (identifier) (ERROR) (number_literal) (identifier))"),
        ("static int y __attribute__((a)) __attribute__((b(1)));", "(declaration (storage_class_specifier) (primitive_type) (identifier) (ERROR))"),
    ],
)
def test_errors_stay_inside_declarations(source, expected):
    assert tree(source) == f"(translation_unit {expected})"
    assert tree(f"{source}\nint z;") == f"(translation_unit {expected} (declaration (primitive_type) (identifier)))"


def test_recovery_keeps_the_rest():
    got = tree("int a = = ; int b; void f() { ) } int c;")
    assert got.count("ERROR") >= 1
    assert got.count("declaration") >= 2


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab(){}[];,*&=.->#\n\"'/ int structifdefine0", max_size=80))
def test_any_text_gives_nested_intervals(source):
    rows = list(node_rows("f.c", source.encode()))
    by_pre = {r[1]: r for r in rows}
    for r in rows:
        assert r[1] <= r[2]
        if r[3] is not None:
            parent = by_pre[r[3]]
            assert parent[1] < r[1] <= r[2] <= parent[2]


def test_deep_nesting_does_not_fail():
    assert parse(b"int x = " + b"(" * 3000 + b"1" + b")" * 3000 + b";").type == "translation_unit"


def test_attribute_macros_after_heads_stay_linear():
    one = "extern int f (int a, T) __THROW;\n"
    began = time.time()
    parse((one * 4000).encode())
    assert time.time() - began < 5
    assert tree("int f(T) X; int g(void) { }").endswith("(function_definition (primitive_type) (function_declarator (identifier) (parameter_list (parameter_declaration (primitive_type)))) (compound_statement)))")


def test_linear_time():
    block = b"int f(int a) { int b = a; if (a) { b = f(b); } return b; }\n"
    began = time.process_time()
    parse(block * 200)
    small = time.process_time() - began
    began = time.process_time()
    parse(block * 1600)
    assert time.process_time() - began < 20 * small + 2
