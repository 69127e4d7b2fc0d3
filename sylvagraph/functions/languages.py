"""Languages by file ending, their groups, and node kinds from grammar kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages with their file endings, groups and paradigms.
EXTENSIONS: dict[str, str] = {
    "Rust": "rs", "C": "c h", "Cpp": "cpp cc cxx hpp hh hxx c++ h++", "Go": "go", "Zig": "zig",
    "Java": "java", "Kotlin": "kt kts", "Scala": "scala sc", "Groovy": "groovy gvy gy gsh",
    "Python": "py pyi pyw", "JavaScript": "js mjs cjs", "TypeScript": "ts mts cts tsx", "Ruby": "rb rake gemspec", "Php": "php phtml php3 php4 php5 phps", "Perl": "pl pm pod t", "Lua": "lua",
    "Haskell": "hs lhs", "OCaml": "ml mli", "FSharp": "fs fsi fsx", "Elixir": "ex exs", "Erlang": "erl hrl", "Clojure": "clj cljs cljc edn", "CommonLisp": "lisp lsp cl", "Scheme": "scm ss",
    "CSharp": "cs", "VbNet": "vb", "Swift": "swift", "ObjectiveC": "m mm", "Bash": "sh bash", "PowerShell": "ps1 psm1 psd1", "Sql": "sql", "GraphQL": "graphql gql",
    "Json": "json", "Yaml": "yaml yml", "Toml": "toml", "Xml": "xml", "Html": "html htm", "Css": "css", "Markdown": "md markdown", "Rholang": "rho", "MeTTa": "metta",
}
GROUPS: dict[str, str] = {
    "systems": "Rust C Cpp Go Zig",
    "jvm": "Java Kotlin Scala Groovy Clojure",
    "scripting": "Python JavaScript TypeScript Ruby Php Perl Lua",
    "functional": "Haskell OCaml FSharp Elixir Erlang Clojure CommonLisp Scheme",
    "markup": "Json Yaml Toml Xml Html Css Markdown",
    "process": "Rholang MeTTa",
}
PARADIGMS: dict[str, str] = {
    "Rust": "Imperative Functional Concurrent", "C": "Imperative Procedural", "Cpp": "Imperative ObjectOriented Functional", "Go": "Imperative Concurrent", "Java": "ObjectOriented Imperative",
    "Python": "ObjectOriented Imperative Functional", "JavaScript": "ObjectOriented Functional Reactive", "TypeScript": "ObjectOriented Functional Reactive", "Haskell": "Functional",
    "Elixir": "Functional Concurrent", "Erlang": "Functional Concurrent", "Rholang": "Concurrent ProcessCalculus", "MeTTa": "Logic Functional",
}
# What a grammar kind's stem stands for, in every language that has it.
STEMS: dict[str, str] = {
    "Root": "source_file program translation_unit document fragment stylesheet stream",
    "Module": "mod package package_clause namespace",
    "Class": "class agent",
    "Struct": "struct type_spec",
    "Enum": "enum",
    "Trait": "trait interface interface_type",
    "Impl": "impl",
    "Function": "function function_signature function_declarator method singleton_method constructor generator_function contract constructor_decl method_decl default_decl",
    "Lambda": "closure lambda arrow_function func",
    "Parameter": "parameter parameters formal_parameter formal_parameters default_parameter typed_parameter required_parameter optional_parameter spread_parameter method_parameters block_parameters",
    "Block": "block compound body rule_set section paragraph heading atx_heading setext_heading",
    "Variable": "let const static variable lexical variable_declarator init_declarator short_var var local_variable variable_assignment",
    "Field": "field public_field pair block_mapping_pair key_value_pair",
    "If": "if unless ifElse",
    "Else": "else elif elsif",
    "While": "while until",
    "For": "for for_in for_of for_range_loop enhanced_for c_style_for",
    "Loop": "loop do",
    "Match": "match switch expression_switch type_switch choice",
    "MatchArm": "match_arm case expression_case type_case default_case switch_case switch_default switch_block_statement_group switch_rule when case_item branch",
    "Return": "return",
    "Break": "break",
    "Continue": "continue next",
    "Try": "try try_with_resources begin",
    "Catch": "catch except rescue",
    "Finally": "finally ensure defer",
    "Throw": "throw raise",
    "BinaryOp": "binary comparison",
    "UnaryOp": "unary not update",
    "Assignment": "assignment compound_assignment augmented_assignment",
    "Call": "call method_call new method_invocation object_creation command",
    "MemberAccess": "field_access member selector attribute_access",
    "IndexAccess": "index subscript array_access element_reference",
    "Identifier": "identifier type_identifier field_identifier property_identifier shorthand_property_identifier package_identifier namespace_identifier constant instance_variable class_variable global_variable property_name class_name id_name tag_name command_name variable_name word",
    "Await": "await go",
    "Yield": "yield",
    "Literal": "integer float string raw_string char character boolean array object number true false null nil none undefined regex list dictionary template_string concatenated_string symbol hash text code_span fenced_code_block",
    "Import": "use import import_from preproc_include export link image",
    "Attribute": "attribute inner_attribute decorator annotation marker_annotation",
    "Macro": "macro_invocation",
    "Comment": "comment line_comment block_comment html_block",
    "Error": "ERROR",
}
ENDINGS = "_statement _expression _expr _declaration _definition _item _clause _literal _operator _specifier _value _scalar".split()
# Kinds that stand for something else in one language than their stem says.
OWN: dict[str, dict[str, str]] = {
    "Rust": {"field_expression": "MemberAccess", "array_expression": "Literal", "type_item": "TypeAnnotation", "generic_type": "GenericParam", "type_parameters": "GenericParam"},
    "Python": {"module": "Root", "attribute": "MemberAccess", "expression_statement": "Comment", "boolean_operator": "BinaryOp"},
    "JavaScript": {"new_expression": "Call"},
    "Go": {"type_declaration": "Struct"},
    "Java": {"switch_expression": "Match", "class_declaration": "Class"},
    "Cpp": {"declaration": "Variable", "field_expression": "MemberAccess", "initializer_list": "Literal", "case_statement": "MatchArm"},
    "Ruby": {"module": "Module", "method": "Function", "block": "Lambda", "do_block": "Lambda", "case": "Match", "body_statement": "Block"},
    "Css": {"declaration": "Variable"},
    "Bash": {"case_statement": "Match"},
}
OWN |= {"TypeScript": OWN["JavaScript"], "C": OWN["Cpp"]}


def from_extension(extension: Column) -> Column:
    """The language of a file ending, with or without a dot, in any case; Unknown if there is none."""
    known = F.create_map(*[F.lit(x) for language, endings in EXTENSIONS.items() for e in endings.split() for x in (e, language)])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_replace(extension, r"^\.+", ""))), F.lit("Unknown"))


def in_group(language: Column, group: str) -> Column:
    return language.isin(*GROUPS[group].split())


def paradigms(language: Column) -> Column:
    known = F.create_map(*[x for k, v in PARADIGMS.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v.split()]))])
    return F.coalesce(F.try_element_at(known, language), F.array().cast("array<string>"))


def extensions(spark: SparkSession) -> DataFrame:
    """language, extension, position."""
    return spark.createDataFrame([(k, e, n) for k, v in EXTENSIONS.items() for n, e in enumerate(v.split())], "language string, extension string, position int")


def node_kind(language: Column, kind: Column) -> Column:
    """The node kind of a grammar kind: a language's own reading, else that of the kind as it stands, else that of its
    stem; else Unknown. (A kind that a language's grammar doesn't have is read as in the others.)"""
    own = F.create_map(*[F.lit(x) for lang, kinds in OWN.items() for k, tag in kinds.items() for x in (f"{lang} {k}", tag)])
    stems = F.create_map(*[F.lit(x) for tag, words in STEMS.items() for w in words.split() for x in (w, tag)])
    stem = F.regexp_replace(kind, f"({'|'.join(ENDINGS)})$", "")
    return F.coalesce(F.try_element_at(own, F.concat_ws(" ", language, kind)), F.try_element_at(stems, kind), F.try_element_at(stems, stem), F.lit("Unknown"))


def should_include(kind: Column, language: Column, named: Column, comments: bool = True) -> Column:
    """Whether a grammar node becomes a node: no punctuation, no comments unless wanted, and in Rholang named ones only."""
    keep = kind.rlike("[A-Za-z0-9_]")
    if not comments:
        keep &= ~kind.isin("comment", "line_comment", "block_comment")
    return keep & ~((language == "Rholang") & ~named)
