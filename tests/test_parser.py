"""The grammar, rule by rule: trees that are made at random and come back, and what each rule refuses."""

import random
import string

import pytest

from quillmere.errors import LimitExceeded, ParseError
from quillmere.plans import ast
from quillmere.plans.parser import KEYWORDS, Limits, parse

FIELDS = ("hull", "ship.name", "_id", "länge", "a-b")
WORDS = ("brig", "Ölzeug", "v2", "x_1", "sloop")


class Maker:
    """Random statements that the grammar can spell."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def one(self, *options):
        return self.rng.choice(options)

    def word(self) -> ast.Value:
        return ast.Word(self.one(*WORDS))

    def number(self) -> ast.Value:
        return parse(f"hull:{self.one('0', '-7', '12', '3.25', '1e3', '-2.5E-2', '64KB', '10%', '9223372036854775807')}").where.value

    def date(self) -> ast.Value:
        return parse(f"hull:{self.one('1999-04', '2021-12-31', '2020-02-29T08:15', 'now', 'today-3d', 'yesterday+1w', '2001-01-01T00:00:01.5Z')}").where.value

    def text(self) -> ast.Value:
        return ast.String("".join(self.one(*string.ascii_letters, " ", '"', "\\", "\n", "\t", "\x01", "é", "船", "/", "'") for _ in range(self.rng.randrange(8))))

    def scalar(self) -> ast.Value:
        return self.one(self.word, self.number, self.date, self.text)()

    def value(self) -> ast.Value:
        kind = self.rng.randrange(9)
        if kind == 0:
            low, high = self.one(None, self.number()), self.number()
            return ast.Range(low, high)
        if kind == 1:
            return ast.Vector(tuple(float(self.rng.randrange(-8, 9)) / 4 for _ in range(self.rng.randrange(1, 5))))
        if kind == 2:
            return ast.Call(self.one("prefix", "substr", "near", "fuzzy", "exists"), tuple(self.scalar() for _ in range(self.rng.randrange(3))))
        if kind == 3:
            return ast.Regex(self.one("ab+c", "^x\\d{2}$", "[^/]*"), frozenset(self.rng.sample("ims", self.rng.randrange(3))))
        return ast.Star() if kind == 4 else self.scalar()

    def clause(self) -> ast.Node:
        field = self.one(None, *FIELDS)
        value = self.value() if field else self.one(self.word, self.text)()
        op = ":" if field is None or not isinstance(value, ast.Word | ast.String | ast.Number | ast.DateTime) else self.one(":", "=", "!=", "<", "<=", ">", ">=")
        return ast.Clause(field, op, value, self.one(1.0, 1.0, 2.5, 0.125))

    def node(self, depth: int) -> ast.Node:
        kind = self.rng.randrange(6) if depth else 5
        if kind == 0:
            return ast.Not(self.node(depth - 1))
        if kind in (1, 2):
            # the parser flattens nested sequences of one kind
            wanted = ast.And if kind == 1 else ast.Or
            kids = [self.node(depth - 1) for _ in range(self.rng.randrange(2, 4))]
            flat = [g for k in kids for g in (k.kids if isinstance(k, wanted) else (k,))]
            return wanted(tuple(flat))
        return self.clause()

    def statement(self) -> ast.Statement:
        keys = tuple(ast.SortKey(self.one("_score", *FIELDS[:3]), self.one(None, "ASC", "DESC")) for _ in range(self.rng.randrange(3)))
        return ast.Statement(
            self.node(3), self.one("", "", "EXPLAIN", "EXPLAIN ANALYZE", "WATCH"), self.one((), (), ("north", "south")), keys, self.one(None, 0, 25), self.one(None, 3), self.one((), ("hull", "länge"))
        )


@pytest.mark.parametrize("seed", range(40))
def test_random_statements_come_back_from_their_text(seed):
    made = Maker(seed)
    for _ in range(25):
        tree = made.statement()
        text = ast.show(tree)
        again = parse(text)
        assert again == tree, text
        assert ast.show(again) == text
        whole = ast.sexpr(again, spans=True)
        assert whole.startswith("(statement @0+") and whole.count("(") == whole.count(")") or '"' in text


def where(text):
    return parse(text).where


def test_an_empty_query_and_a_star_have_no_condition_or_a_star():
    assert where("") is None and where("   ") is None
    assert where("*").value == ast.Star()


def test_words_side_by_side_and_their_signs_are_one_conjunction():
    for text in ("sloop brig", "sloop AND brig", "sloop && brig", "(sloop) (brig)", "sloop AND (brig)"):
        assert where(text) == where("sloop AND brig")
    assert [type(k) for k in where("sloop -brig !yawl NOT ketch").kids] == [ast.Clause, ast.Not, ast.Not, ast.Not]


def test_or_binds_weaker_than_and_and_not_binds_strongest():
    tree = where("NOT x y || z")
    assert isinstance(tree, ast.Or) and isinstance(tree.kids[0], ast.And) and isinstance(tree.kids[0].kids[0], ast.Not)
    assert where("(x OR y) OR z") == where("x OR (y OR z)") == where("x OR y OR z")
    assert ast.show_node(where("x AND (y OR z)")) == "x AND (y OR z)" and ast.show_node(where("NOT (x OR y)")) == "NOT (x OR y)"


def test_operators_stand_with_or_without_a_colon():
    for op in ("=", "!=", "<", "<=", ">", ">=", "~"):
        assert where(f"hull{op}9") == where(f"hull:{op}9") and where(f"hull{op}9").op == op


def test_groups_carry_their_field_and_become_lists_where_that_is_all():
    assert where("hull:(oak OR elm OR ash)").value == ast.AnyOf((ast.Word("oak"), ast.Word("elm"), ast.Word("ash")))
    assert {c.field for c in ast.clauses(where("hull:((oak elm) OR NOT ash)"))} == {"hull"}
    assert [c.op for c in ast.clauses(where("hull:(>3 AND <=8)"))] == [">", "<="]
    assert {c.boost for c in ast.clauses(where("hull:(>3 AND <=8)^4"))} == {4.0}


def test_numbers_keep_their_spelling_their_value_and_their_unit():
    cases = {"12": (12, 12.0, ""), "-0": (0, 0.0, ""), "2.50": (None, 2.5, ""), "1e2": (None, 100.0, ""), "7GB": (7, 7.0, "GB"), "18446744073709551616": (None, 2.0**64, ""), str(-(2**63)): (-(2**63), -(2.0**63), "")}
    for text, (integer, value, suffix) in cases.items():
        n = where(f"hull:{text}").value
        assert (n.raw, n.integer, n.value, n.suffix) == (text, integer, value, suffix)


def test_ranges_are_open_at_a_star():
    assert where("hull:3..9").value.low.value == 3 and where("hull:3..*").value.high is None and where("hull:*..9").value.low is None


def test_dates_know_their_precision():
    for text, precision in (("1912-04", "month"), ("1912-04-15", "day"), ("1912-04-15T02:20", "minute"), ("1912-04-15T02:20:00", "second"), ("1912-04-15T02:20:00.25", "fraction"), ("now-2h", "relative")):
        assert where(f"hull:{text}").value.precision == precision
    east, west = (where(f"hull:1912-04-15T02:20:00{z}").value.zone_minutes for z in ("+05:30", "-03:00"))
    assert (east, west) == (330, -180)


def test_strings_and_expressions_undo_their_escapes():
    assert where(r'hull:"a\"b\\c\ndé🚢"').value.text == 'a"b\\c\ndé\U0001f6a2'
    assert where(r"hull:'it\'s'").value.text == "it's"
    assert where(r"hull:/a\/b/is").value == ast.Regex("a/b", frozenset("is"))


def test_tails_stand_in_any_order():
    one = parse("brig SORT BY hull DESC, _id LIMIT 5 OFFSET 2 FACET hull")
    assert parse("brig FACET hull OFFSET 2 LIMIT 5 SORT BY hull DESC,_id") == one
    assert one.sort == (ast.SortKey("hull", "DESC"), ast.SortKey("_id")) and (one.limit, one.offset, one.facets) == (5, 2, ("hull",))


def test_modes_sources_and_parameters():
    s = parse("EXPLAIN ANALYZE SOURCE(east, west) hull(k=3,w=oak):elm")
    assert (s.mode, s.sources) == ("EXPLAIN ANALYZE", ("east", "west")) and dict(s.where.params)["w"] == ast.Word("oak")
    assert parse("WATCH brig").mode == "WATCH"


def test_spans_are_bytes_of_the_text():
    clause = where("é ship.name:brig").kids[1]
    assert clause.span[0] == 3 and clause.span[1] == len("ship.name:brig")


#: By rule: what is left out, what is too much, what is spelled wrong.
WRONG = {
    "a value is missing": ["hull:", "hull:>=", "hull~", "brig hull:"],
    "an operand is missing": ["OR brig", "brig AND", "brig OR OR elm", "brig && || elm", "!", "brig NOT"],
    "a bracket does not match": ["((brig)", "brig)", "hull:(oak", "hull:[1,2", "hull:prefix(oak", "()"],
    "a string or an expression is open or broken": ['hull:"oak', "hull:'oak", "hull:/oak", r'hull:"\x"', r'hull:"\u12"', r'hull:"\uDBFF"', "hull:/oak/q"],
    "a number cannot be": ["hull:1e400", "hull:[1e400]", "brig^x", "brig^3GB"],
    "a range cannot be": ["hull:2..", "hull:1..2..3"],
    "a date cannot be": ["hull:2021-02-30", "hull:2021-00", "hull:2021-05-05T25:00", "hull:now-99999999999999999999d"],
    "a list cannot be": ["hull:[1,]", "hull:[oak]", "hull:near(,1)"],
    "a tail cannot be": ["LIMIT", "LIMIT x", "LIMIT 2.0", "OFFSET -3", "SORT BY", "SORT hull", "OFFSET 1 OFFSET 1", "FACET ,"],
    "a source or a parameter is missing": ["SOURCE(,)", "SOURCE(east", "hull(k):oak", "hull(=3):oak"],
    "there is a NUL": ["br\0ig"],
}


@pytest.mark.parametrize("rule,text", [(r, t) for r, texts in WRONG.items() for t in texts])
def test_what_breaks_a_rule_is_refused_at_a_place(rule, text):
    with pytest.raises(ParseError) as e:
        parse(text)
    assert e.value.code == "PARSE" and e.value.message and 0 <= e.value.pos <= len(text.encode())


def test_each_limit_is_held():
    for text, limits in (("schooner", Limits(query_bytes=7)), ("(((x)))", Limits(depth=2)), ("w x y z", Limits(clauses=3)), ("hull:[1,2,3,4]", Limits(items=3))):
        with pytest.raises(LimitExceeded):
            parse(text, limits)
    assert parse("schooner", Limits(query_bytes=8)).where.value.text == "schooner"


def test_texts_that_are_cut_and_spliced_parse_or_are_refused():
    made, rng = Maker(99), random.Random(4711)
    texts = [ast.show(made.statement()) for _ in range(60)]
    for _ in range(2500):
        a, b = rng.choice(texts), rng.choice(texts)
        text = a[: rng.randrange(len(a) + 1)] + rng.choice(["", " ", "(", ")", '"', "/", "..", "^", "!", *sorted(KEYWORDS)]) + b[rng.randrange(len(b) + 1) :]
        try:
            tree = parse(text)
        except (ParseError, LimitExceeded):
            continue
        assert parse(ast.show(tree)) == tree, text
