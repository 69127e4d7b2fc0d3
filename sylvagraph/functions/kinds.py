"""Node and edge kinds and the predicates on them, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of kinds and the groups they belong to.
DECLARATIONS = ("Module", "Class", "Struct", "Enum", "Trait", "Function", "Variable", "Field", "Parameter")
STATEMENTS = ("Return", "If", "While", "For", "Loop", "Match", "Break", "Continue", "Throw", "Try")
EXPRESSIONS = ("BinaryOp", "UnaryOp", "Assignment", "Call", "MemberAccess", "IndexAccess", "Identifier", "Literal", "Lambda", "Await", "Yield")
CONTROL_FLOW = ("If", "While", "For", "Loop", "Match", "Break", "Continue", "Return", "Throw", "Try")
NAMED = ("Module", "Class", "Struct", "Enum", "Trait", "Function", "Parameter", "Variable", "Field", "MemberAccess", "Identifier", "GenericParam", "Import", "Attribute", "Macro")
SCOPES = ("Block", "Function")
# Groups that relaxed matching uses; they are narrower than the ones above.
MATCH_DECLARATIONS = ("Module", "Class", "Struct", "Enum", "Trait", "Function", "Variable", "Field")
MATCH_EXPRESSIONS = ("BinaryOp", "UnaryOp", "Call", "MemberAccess", "IndexAccess", "Identifier", "Literal", "Lambda")
MATCH_STATEMENTS = ("Return", "If", "While", "For", "Loop", "Match", "Break", "Continue")
# Edge families.
AST = ("AstChild", "AstParent", "AstNextSibling", "AstPrevSibling")
PDG = ("ControlDependence", "DataDependence")
CALL = ("StaticCall", "DynamicCall", "CallSite")
TYPE = ("TypeOf", "Inherits", "Implements", "GenericInstance")
CFG_CONDITIONAL = ("ConditionalTrue", "ConditionalFalse", "Case", "DefaultCase")
CFG_LOOP = ("LoopBack", "LoopExit", "Break", "Continue")
CFG_EXCEPTION = ("Throw", "Catch")
DFG_READ = ("DefUse", "FieldRead", "IndexRead", "Dereference")
DFG_WRITE = ("UseDef", "FieldWrite", "IndexWrite")


def _in(column: str | Column, values: tuple[str, ...]) -> Column:
    return (F.col(column) if isinstance(column, str) else column).isin(*values)


def is_declaration(tag: str | Column = "tag") -> Column:
    return _in(tag, DECLARATIONS)


def is_statement(tag: str | Column = "tag") -> Column:
    return _in(tag, STATEMENTS)


def is_expression(tag: str | Column = "tag") -> Column:
    return _in(tag, EXPRESSIONS)


def is_control_flow(tag: str | Column = "tag") -> Column:
    return _in(tag, CONTROL_FLOW)


def is_error(tag: str = "tag") -> Column:
    return F.col(tag) == "Error"


def is_conditional(subkind: str = "subkind") -> Column:
    return _in(subkind, CFG_CONDITIONAL)


def is_loop(subkind: str = "subkind") -> Column:
    return _in(subkind, CFG_LOOP)


def is_exception(subkind: str = "subkind") -> Column:
    return _in(subkind, CFG_EXCEPTION)


def is_read(subkind: str = "subkind") -> Column:
    return _in(subkind, DFG_READ)


def is_write(subkind: str = "subkind") -> Column:
    return _in(subkind, DFG_WRITE)


def is_forward(kind: str = "kind", subkind: str = "subkind") -> Column:
    return ~(_in(kind, ("AstParent", "AstPrevSibling")) | (F.coalesce(F.col(subkind), F.lit("")) == "UseDef"))


def family(kind: str = "kind") -> Column:
    """ast, cfg, dfg, pdg, call, type, else the rest's own name."""
    k = F.col(kind)
    return (
        F.when(_in(kind, AST), "ast").when(k == "ControlFlow", "cfg").when(k == "DataFlow", "dfg").when(_in(kind, PDG), "pdg")
        .when(_in(kind, CALL), "call").when(_in(kind, TYPE), "type").when(_in(kind, ("Defines", "References", "Captures")), "reference")
        .when(_in(kind, ("ScopeContains", "ScopeParent")), "scope").otherwise("import")
    )


def match_class(tag: str = "tag") -> Column:
    """What relaxed matching compares: the group of a kind, or the kind itself."""
    return F.when(_in(tag, MATCH_DECLARATIONS), "decl").when(_in(tag, MATCH_EXPRESSIONS), "expr").when(_in(tag, MATCH_STATEMENTS), "stmt").otherwise(F.col(tag))


def parse_integer(text: str) -> Column:
    """Value of an integer literal: underscores out, 0x, 0b and 0o prefixes; garbage or overflow gives 0."""
    t = F.regexp_replace(F.col(text), "_", "")
    body = F.substring(t, 3, 1000)
    hexed = F.when((F.length(body) <= 16) & body.rlike("^[0-9a-fA-F]+$"), F.expr(f"try_cast(conv(substring(replace({text}, '_', ''), 3), 16, 10) AS bigint)"))
    octal = F.when((F.length(body) <= 21) & body.rlike("^[0-7]+$"), F.expr(f"try_cast(conv(substring(replace({text}, '_', ''), 3), 8, 10) AS bigint)"))
    binary = F.when((F.length(body) <= 64) & body.rlike("^[01]+$"), F.expr(f"try_cast(conv(substring(replace({text}, '_', ''), 3), 2, 10) AS bigint)"))
    plain = F.when(t.rlike("^[+-]?[0-9]+$"), t.try_cast("bigint"))
    return F.coalesce(F.when(t.rlike("^0[xX]"), hexed).when(t.rlike("^0[oO]"), octal).when(t.rlike("^0[bB]"), binary).otherwise(plain), F.lit(0).cast("bigint"))
