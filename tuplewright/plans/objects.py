"""Programs as data: node kinds of the analysed language, and the parser that makes trees of them.

The analysed language is the rule language itself.  The same parser reads whole programs
and patterns; in a pattern, ``$x`` stands for any subtree that its place admits and ``...``
for any elements of a list.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .syntax import ProgramError

# Kinds, their supertypes and the declared types of their children (a star: a list).
KINDS: dict[str, tuple[str | None, tuple[str, ...]]] = {
    "Program": (None, ("CommonClause*",)),
    "CommonClause": (None, ()),
    "Clause": ("CommonClause", ("CommonLiteral*",)),
    "Rule": ("Clause", ("CommonLiteral*", "CommonLiteral*")),
    "Fact": ("Clause", ("CommonLiteral*",)),
    "AnalyzeBlock": ("CommonClause", ("PredicateRef", "StringConstant", "Clause*")),
    "CommonLiteral": (None, ()),
    "Literal": ("CommonLiteral", ("PredicateSymbol",)),
    "BinaryExclusiveTermLiteral": ("Literal", ("PredicateSymbol", "Expr", "Expr")),
    "Atom": ("Literal", ("PredicateSymbol", "Term*")),
    "EDBLiteral": ("Literal", ("PredicateSymbol", "PredicateRef", "Term")),
    "OUTPUTLiteral": ("Literal", ("PredicateSymbol", "Term")),
    "NEGLiteral": ("Literal", ("PredicateSymbol", "Literal")),
    "BINDLiteral": ("Literal", ("PredicateSymbol", "CommonVariable", "Expr")),
    "IMPORTLiteral": ("Literal", ("PredicateSymbol", "PredicateRef", "StringConstant", "StringConstant")),
    "EQLiteral": ("BinaryExclusiveTermLiteral", ("PredicateSymbol", "Expr", "Expr")),
    "NEQLiteral": ("BinaryExclusiveTermLiteral", ("PredicateSymbol", "Expr", "Expr")),
    "LTLiteral": ("BinaryExclusiveTermLiteral", ("PredicateSymbol", "Expr", "Expr")),
    "LTELiteral": ("BinaryExclusiveTermLiteral", ("PredicateSymbol", "Expr", "Expr")),
    "GTLiteral": ("BinaryExclusiveTermLiteral", ("PredicateSymbol", "Expr", "Expr")),
    "GTELiteral": ("BinaryExclusiveTermLiteral", ("PredicateSymbol", "Expr", "Expr")),
    "Expr": (None, ()),
    "Functor": ("Expr", ("FunctorSymbol", "Expr*")),
    "Term": ("Expr", ()),
    "Constant": ("Term", ()),
    "CommonVariable": ("Term", ()),
    "Variable": ("CommonVariable", ()),
    "Wildcard": ("CommonVariable", ()),
    "PredicateRef": ("Constant", ()),
    "StringConstant": ("Constant", ()),
    "IntConstant": ("Constant", ()),
    "FormalPredicate": (None, ()),
    "PredicateSymbol": (None, ()),
    "FunctorSymbol": (None, ()),
    "MetaPattern": ("CommonLiteral", ()),
    "Pattern": ("MetaPattern", ()),
    "BoundedPattern": ("Pattern", ("CommonVariable",)),
}
COMPARISONS = ("EQ", "NEQ", "LT", "LTE", "GT", "GTE")
#: What a pattern as a whole may be.
ROOTS = ("clause", "literal", "expr")


def supertypes(kind: str) -> list[str]:
    """The kind itself and all above it."""
    out = []
    while kind:
        out.append(kind)
        kind = KINDS[kind][0] if kind in KINDS else None
    return out


def is_final(kind: str) -> bool:
    return all(up != kind for up, _ in KINDS.values())


@dataclass
class Tree:
    """``span``: first and last line and column.  ``hole``: the name of a metavariable, then ``kind`` is the widest kind it may have; ``gap``: any list elements."""

    kind: str
    children: list[Tree] = field(default_factory=list)
    tokens: list[tuple[str, str]] = field(default_factory=list)
    span: tuple[int, int, int, int] = (0, 0, 0, 0)
    hole: str | None = None
    gap: bool = False


_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
      | (?P<if>:-) | (?P<gap>\.\.\.) | (?P<pattern><:.*?:>)
      | (?P<hole>[$`](?:[a-z][A-Za-z0-9_]*|_))
      | (?P<int>[0-9]+) | (?P<string>"[^"]*") | (?P<ref>'[A-Z][A-Za-z0-9_]*)
      | (?P<pred>[A-Z][A-Za-z0-9_]*) | (?P<var>[a-z][A-Za-z0-9_]*) | (?P<wild>_)
      | (?P<mark>[(){},.+\-*/])""",
    re.X | re.S,
)


class _Reader:
    def __init__(self, text: str, pattern: bool):
        self.tokens: list[tuple[str, str, int, int]] = []  # kind, text, line, column
        self.pattern = pattern
        self.at, line, start, place = 0, 1, 0, 0
        while place < len(text):
            m = _TOKEN.match(text, place)
            if not m or (not pattern and m.lastgroup in ("gap", "hole")):
                raise ProgramError(f"Syntax error in line {line}: unexpected {text[place]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0], line, place - start + 1))
            if "\n" in m[0]:
                line, start = line + m[0].count("\n"), place + m[0].rindex("\n") + 1
            place = m.end()
        self.tokens += [("end", "", line, place - start + 1)] * 3  # one may be taken, one is looked at ahead

    def sees(self, kind: str, text: str | None = None, ahead: int = 0) -> bool:
        token = self.tokens[self.at + ahead]
        return token[0] == kind and (text is None or token[1] == text)

    def take(self, kind: str, text: str | None = None) -> str:
        if not self.sees(kind, text):
            _, t, line, _ = self.tokens[self.at]
            raise ProgramError(f"Syntax error in line {line}: expected {text or kind}, got {t or 'the end'}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def tree(self, begin: int, kind: str, children: list[Tree] = (), tokens: list[tuple[str, str]] = ()) -> Tree:
        """A node over the tokens from ``begin`` up to the next one to read."""
        _, _, line, column = self.tokens[begin]
        _, last, last_line, last_column = self.tokens[max(self.at - 1, begin)]
        return Tree(kind, list(children), list(tokens), (line, column, last_line, last_column + max(len(last), 1) - 1))

    def hole(self, kind: str) -> Tree:
        begin = self.at
        out = self.tree(begin, kind)
        out.hole = "$" + self.take("hole")[1:]
        return out

    def many(self, element, end: tuple[str, ...] | None) -> Tree:
        """Elements with commas between them; ``end``: the closing mark of a list that may be empty."""
        begin, out = self.at, []
        if end is None or not self.sees(*end):
            while True:
                if self.sees("gap"):
                    self.at += 1
                    out.append(Tree("", gap=True))
                else:
                    out.append(element())
                if not self.sees("mark", ","):
                    break
                self.at += 1
        return self.tree(begin, "List", out)

    def leaf(self, kind: str, token: str, name: str, cut: int = 0) -> Tree:
        begin = self.at
        text = self.take(token)
        return self.tree(begin, kind, [], [(name, text[cut : len(text) - cut] if token == "string" else text[cut:])])

    def symbol(self) -> Tree:
        return self.hole("PredicateSymbol") if self.sees("hole") else self.leaf("PredicateSymbol", "pred", "PRED_ID")

    def reference(self) -> Tree:
        return self.hole("PredicateRef") if self.sees("hole") else self.leaf("PredicateRef", "ref", "PRED_ID", 1)

    def text(self) -> Tree:
        return self.hole("StringConstant") if self.sees("hole") else self.leaf("StringConstant", "string", "STRING", 1)

    def variable(self) -> Tree:
        return self.hole("Variable") if self.sees("hole") else self.leaf("Variable", "var", "VAR_ID")

    # the grammar proper

    def program(self) -> Tree:
        begin, out = self.at, []
        while not out or not self.sees("end"):
            out.append(self.clause())
        return self.tree(begin, "Program", [self.tree(begin, "List", out)])

    def clause(self, kind: str = "CommonClause") -> Tree:
        begin = self.at
        if kind == "CommonClause" and self.sees("var", "analyze") and self.sees("mark", "(", 1):
            return self.block()
        if self.sees("hole") and not any(self.sees("mark", m, 1) for m in "(,.") and not self.sees("if", None, 1) and not self.sees("pattern", None, 1):
            return self.hole(kind)
        heads = self.many(self.literal, None)
        body = None
        if self.sees("if"):
            self.at += 1
            body = self.many(self.literal, None)
        self.take("mark", ".")
        return self.tree(begin, "Fact" if body is None else "Rule", [heads] if body is None else [heads, body])

    def block(self) -> Tree:
        begin = self.at
        self.take("var", "analyze")
        self.take("mark", "(")
        about = self.reference()
        language = Tree("StringConstant", [], [] if self.pattern else [("STRING", "rules")], self.tree(begin, "").span, "$_" if self.pattern else None)
        if self.sees("mark", ","):
            self.at += 1
            language = self.text()
        self.take("mark", ")")
        self.take("mark", "{")
        first, inner = self.at, []
        while not inner or not self.sees("mark", "}"):
            inner.append(self.clause("Clause"))
        clauses = self.tree(first, "List", inner)
        self.take("mark", "}")
        return self.tree(begin, "AnalyzeBlock", [about, language, clauses])

    def literal(self, inner: bool = False) -> Tree:
        """``inner``: below a NOT, where no pattern may stand."""
        begin = self.at
        if not inner and self.sees("pattern"):
            return self.leaf("Pattern", "pattern", "PATTERN", 2)
        if not inner and (self.sees("var") or self.sees("hole")) and self.sees("pattern", None, 1):
            var = self.variable()
            return self.tree(begin, "BoundedPattern", [var], [("PATTERN", self.take("pattern")[2:])])
        if self.sees("hole") and not self.sees("mark", "(", 1):
            return self.hole("Literal" if inner else "CommonLiteral")
        pred = self.symbol()
        name = pred.tokens[0][1] if pred.tokens else ""
        self.take("mark", "(")
        if name in COMPARISONS:
            kind, parts = name + "Literal", (self.expr, self.expr)
        elif name == "NOT":
            kind, parts = "NEGLiteral", (lambda: self.literal(True),)
        elif name == "BIND":
            kind, parts = "BINDLiteral", (self.variable, self.expr)
        else:
            terms = self.many(self.term, ("mark", ")"))
            kind, parts = "Atom", ()
        children = [pred] if kind != "Atom" else [pred, terms]
        for i, part in enumerate(parts):
            if i:
                self.take("mark", ",")
            children.append(part())
        self.take("mark", ")")
        if kind == "Atom" and not any(t.gap or t.hole for t in terms.children):
            children, kind = self.special(name, children)
        return self.tree(begin, kind, children)

    def special(self, name: str, children: list[Tree]) -> tuple[list[Tree], str]:
        """Inputs and outputs in their short form have kinds of their own; the long form of three texts is an atom."""
        pred, terms = children
        kinds = [t.kind for t in terms.children]
        if name == "EDB" and len(kinds) == 2 and kinds[0] == "PredicateRef":
            return [pred, *terms.children], "EDBLiteral"
        if name == "OUTPUT" and len(kinds) == 1:
            return [pred, *terms.children], "OUTPUTLiteral"
        if name == "IMPORT" and kinds == ["PredicateRef", "StringConstant", "StringConstant"]:
            return [pred, *terms.children], "IMPORTLiteral"
        return children, "Atom"

    def term(self, kind: str = "Term") -> Tree:
        begin = self.at
        if self.sees("hole"):
            return self.hole(kind)
        if self.sees("var"):
            return self.variable()
        if self.sees("int"):
            return self.leaf("IntConstant", "int", "NUMERAL")
        if self.sees("string"):
            return self.text()
        if self.sees("ref"):
            return self.reference()
        self.take("wild")
        return self.tree(begin, "Wildcard")

    def expr(self) -> Tree:
        if self.sees("var") and self.sees("mark", "(", 1):
            begin = self.at
            name = self.leaf("FunctorSymbol", "var", "FUNC_ID")
            self.take("mark", "(")
            arguments = self.many(self.expr, ("mark", ")"))
            self.take("mark", ")")
            return self.tree(begin, "Functor", [name, arguments])
        return self.chain({"+": "add", "-": "sub"}, lambda: self.chain({"*": "mul", "/": "div"}, self.unit))

    def chain(self, signs: dict[str, str], part) -> Tree:
        begin = self.at
        out = part()
        while any(self.sees("mark", s) for s in signs):
            sign = self.at
            name = signs[self.take("mark")]
            symbol = self.tree(sign, "FunctorSymbol", [], [("FUNC_ID", name)])
            right = part()
            out = self.tree(begin, "Functor", [symbol, self.tree(begin, "List", [out, right])])
        return out

    def unit(self) -> Tree:
        if self.sees("mark", "("):
            self.at += 1
            out = self.expr()
            self.take("mark", ")")
            return out
        return self.term("Expr")


def read_program(text: str) -> Tree:
    return _Reader(text, False).program()


def readings(text: str) -> list[Tree]:
    """All trees that a pattern's text may be, one for each root it fits; an error if it fits none."""
    out, faults = [], []
    for root in ROOTS:
        reader = _Reader(text, True)
        try:
            tree = getattr(reader, root)()
            reader.take("end")
            out.append(tree)
        except ProgramError as e:
            faults += [m for m in e.messages if m not in faults]
    if not out:
        raise ProgramError(f"No reading of the pattern <:{text}:>.", *faults)
    return out
