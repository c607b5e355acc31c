"""Decoding, reading, rendering and rewriting of trees; random trees against a plain model."""

import json
import random

import pytest
from pyspark.sql import functions as F
from spanloom.functions import (
    S,
    debug_text,
    has_children,
    is_defined,
    name_at,
    name_is,
    node_path,
    render,
    require_name,
    subtree,
    tokenize,
    tokenized,
    tree_from_json,
    tree_from_text,
    tree_from_text_shallow,
    update,
)
from spanloom.functions.tree import _WRITER_TOKEN

from samples import DEEP, HOLLOW, MALFORMED, TYPICAL, evaluate, rows, trees


# ---------------------------------------------------------------- plain model


class Node:
    def __init__(self, name="", children=()):
        self.name, self.children = name, list(children)

    def null(self):
        return not self.name and all(c.null() for c in self.children)

    def parent(self):
        return any(not c.null() for c in self.children)

    def text(self):
        return self.name + ("(" + ", ".join(c.text() for c in self.children) + ")" if self.parent() else "")

    def at(self, path):
        node = self
        for i in path:
            node = Node(node.name) if i == 0 else (node.children[i - 1] if i <= len(node.children) else Node())
        return node

    def debug(self, path=()):
        label = ".".join(map(str, (*path, 0) if self.parent() else path))
        lines = [label + "." * (8 + 2 * len(path) - len(label)) + self.name]
        if self.parent():
            lines += [c.debug((*path, i + 1)) for i, c in enumerate(self.children)]
        return "\n".join(lines)

    def json(self):
        if not self.children and self.name:
            return self.name if self.name != "null" else None
        return {"type": self.name, "fields": [c.json() for c in self.children]}

    def raw(self):
        return self.name + ("(" + ",".join(c.raw() for c in self.children) + ")" if self.children else "")


def random_tree(rng, depth=0):
    name = rng.choice(["", "a", "Fn", "x y", "null", "é中", "long" * 5])
    if depth > 4 or rng.random() < 0.4:
        return Node(name)
    return Node(name, [random_tree(rng, depth + 1) for _ in range(rng.randint(1, 4))])


PATHS = ["", "0", "1", "2", "1.0", "1.1", "2.1.0", "3.2.1", "1.1.1.1", "0.0", "0.1"]


@pytest.fixture(scope="module")
def random_trees():
    rng = random.Random(7)
    return [random_tree(rng) for _ in range(150)]


@pytest.mark.parametrize("form", ["text", "json", "spaced json"])
def test_random_trees(spark, random_trees, form):
    if form == "text":
        source, decode = [t.raw() for t in random_trees], tree_from_text
    elif form == "json":
        source = [json.dumps(t.json(), separators=(",", ":"), ensure_ascii=False) for t in random_trees]
        decode = tree_from_json
    else:
        source, decode = [json.dumps(t.json(), indent=1, sort_keys=True) for t in random_trees], tree_from_json
    frame = spark.createDataFrame(list(enumerate(source)), "i int, s string").withColumn("t", decode("s").column)
    t = "t"
    found = frame.select(
        "i",
        debug_text(t).column.alias("debug"),
        *[render(t, p).column.alias(f"r{k}") for k, p in enumerate(PATHS)],
        *[is_defined(t, p).column.alias(f"d{k}") for k, p in enumerate(PATHS)],
        *[name_at(t, p).column.alias(f"n{k}") for k, p in enumerate(PATHS)],
        *[render(subtree(t, p)).column.alias(f"s{k}") for k, p in enumerate(PATHS)],
        *[has_children(t, p).column.alias(f"h{k}") for k, p in enumerate(PATHS)],
    ).collect()
    for row in found:
        model = random_trees[row.i]
        assert row.debug == model.debug()
        for k, p in enumerate(PATHS):
            node = model.at([int(x) for x in p.split(".")] if p else [])
            assert row[f"r{k}"] == node.text() == row[f"s{k}"], (model.raw(), p)
            assert row[f"d{k}"] == (not node.null()), (model.raw(), p)
            assert row[f"n{k}"] == (node.name or None)
            assert row[f"h{k}"] == node.parent()


# ---------------------------------------------------------------- JSON


GOOD = r'{"type":"Tuple3","fields":["x","y",{"type":"RPC","fields":["a","b","I\'m a \"request\""]}]}'.replace(
    r"\'", "'"
)


def decode(spark, *lines):
    frame = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    return [r[0] for r in frame.orderBy("i").select(tree_from_json("line").column).collect()]


def test_json_event(spark):
    (tree,) = decode(spark, GOOD)
    assert list(zip(tree.path, tree.name)) == [
        ("", "Tuple3"),
        ("1", "x"),
        ("2", "y"),
        ("3", "RPC"),
        ("3.1", "a"),
        ("3.2", "b"),
        ("3.3", 'I\'m a "request"'),
    ]


def test_json_key_order_and_spacing(spark):
    swapped = '{"fields": ["x", {"fields": [null, ["q"]], "type": "B\\n"}],\n "type": "A"}'
    direct = '{"type":"A","fields":["x",{"type":"B\\n","fields":[null,["q"]]}]}'
    one, other = decode(spark, swapped, direct)
    assert one == other and one.name == ["A", "x", "B\n", "null", "", "q"]


@pytest.mark.parametrize(
    "line",
    [
        '{"fields":["a","b"]}',
        '{"type":"a"}',
        '{"type":1,"fields":[]}',
        '{"type":["a"],"fields":[]}',
        '{"type":"a","fields":{}}',
        '{"type":"a","fields":[1]}',
        '{"type":"a","fields":[true]}',
        '{"type":"a","fields":["x"]} "y"',
        '{"type":"a","fields":["x"]}]',
        '{"type":"a","fields":["x" "y"]}',
        '{"type":"a","fields":["x",]}',
        '{"type":"a","fields":["x"]',
        '{"type":"a","fields":["x"}',
        '{"type":"a","fields":["x"}]',
        '{"type":"a","fields":[["x"]}',
        '{"type":"a","fields":[["x"]}]}',
        '{"type":"a","fields":[["x"]}]]',
        '{"fields":["x"],"type":"a"',
        '{"fields":["x"]}',
        '{"type":"a","fields":["x"],"type":"a"}',
        '{"type":"a","fields":["x"],"more":[]}',
        '{"fields":[["x"],"type":"a"]}',
        '["x"]}',
        '["x"',
        '[,"x"]',
        '["x",,"y"]',
        '["x",]',
        ',"x"',
        '"x",',
        '["x"],',
        "[null null]",
        "[nu ll]",
        "[nullnull]",
        '["x"null]',
        '[["x"]["y"]]',
        '{"type":"a" "fields":[]}',
        '["tab\there"]',
        '["\\x"]',
        '["\\u12g4"]',
        '["open]',
        "]",
        "]}",
        "{}",
        "",
        " ",
        "text",
    ],
)
def test_json_rejects(spark, line):
    assert decode(spark, line) == [None]


def accepted(text):
    """The same decision and nodes with Python's own parser."""

    def pairs(found):
        if sorted(k for k, _ in found) != ["fields", "type"]:
            raise ValueError
        return ("object", dict(found))

    def nodes(value, path):
        at = ".".join(map(str, path))
        if value is None or isinstance(value, str):
            return [(at, "null" if value is None else value)]
        name = ""
        if isinstance(value, tuple):
            name, value = value[1]["type"], value[1]["fields"]
            if not isinstance(name, str):
                raise ValueError
        if not isinstance(value, list):
            raise ValueError
        return [(at, name)] + [n for i, v in enumerate(value) for n in nodes(v, (*path, i + 1))]

    try:
        found = nodes(json.loads(text, object_pairs_hook=pairs), ())
        # Halves of surrogate pairs are no text.
        return [(at, "".join("?" if "\ud800" <= c <= "\udfff" else c for c in name)) for at, name in found]
    except ValueError:
        return None


def test_json_broken_at_random(spark):
    """Well-formed lines with a few characters changed: the same ones are events, with the same nodes."""
    rng = random.Random(12)

    def value(depth=0):
        pick = rng.random()
        if depth > 3 or pick < 0.5:
            return rng.choice([None, "a", "", "é\n", 'q"', "\\", "]},[", "null", "/", "\u0001x", "😀"])
        fields = [value(depth + 1) for _ in range(rng.randint(0, 3))]
        if pick < 0.6:
            return fields
        both = [("type", rng.choice(["T", "", 'x"y'])), ("fields", fields)]
        return dict(both if pick < 0.9 else both[::-1])

    lines = []
    for _ in range(1500):
        separators = rng.choice([(",", ":"), (", ", ": "), (" ,\t", " :")])
        line = json.dumps(value(), separators=separators, ensure_ascii=rng.random() < 0.5)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            at = rng.randrange(len(line) + 1)
            cut = rng.choice([0, 1, 1, 2])
            line = line[:at] + rng.choice(["", "", ",", "]", "}", "[", '"', " ", "{", "null", "x", "\\", ":"]) + line[at + cut :]
        lines.append(line)
    wanted = [accepted(line) for line in lines]
    assert 300 < sum(w is None for w in wanted) < 1200
    for line, got, want in zip(lines, decode(spark, *lines), wanted):
        assert (got and list(zip(got.path, got.name))) == want, line


def test_json_escapes(spark):
    text = r'["\"\\\/\b\f\n\r\t", "\u0041\u00e9\u4e2d", "\ud83d\ude00!", "a\ud83d", "\ude00b", "\ud83d\ud83d\ude00\ude00", "\\u0041"]'
    (tree,) = decode(spark, text)
    assert tree.name[1:] == ['"\\/\b\f\n\r\t', "Aé中", "😀!", "a?", "?b", "?😀?", r"\u0041"]


def test_json_without_limits(spark):
    """Five thousand levels, and values longer than any parser's own limit."""
    depth = 5000
    nested = '{"type":"d","fields":["s",' * depth + '"bottom"' + "]}" * depth
    other = "[" * depth + '{"fields":[],"type":"late"}' + "]" * depth
    frame = spark.createDataFrame([(nested,), (other,), (nested[:-1],), (other[:-2] + "]}",)], "line string")
    made = frame.select(tree_from_json("line").column.alias("t")).selectExpr("size(t.path) AS n", "t.name[size(t.name) - 1] AS last", "length(array_max(t.path)) AS deepest")
    assert [tuple(r) for r in made.collect()] == [(2 * depth + 1, "bottom", 2 * depth - 1), (depth + 1, "late", 2 * depth - 1), (None, None, None), (None, None, None)]
    long = spark.range(1).selectExpr("""concat('{"type":"T","fields":["', repeat('x', 25000000), '",["', repeat('y\\\\n', 6250000), '"]]}') AS line""")
    made = long.select(tree_from_json("line").column.alias("t")).selectExpr("length(t.name[1])", "length(t.name[3])", "t.path[3]")
    assert tuple(made.first()) == (25_000_000, 12_500_000, "2.1")


def test_json_steps(spark):
    """Brackets that close together are one step, whatever they close; no step tries a cast that fails."""
    assert "try_cast" not in tree_from_json("line").text
    depth = 40
    deep = '{"type":"d","fields":["s",[' * depth + '"x"' + "]]}" * depth
    frame = spark.createDataFrame([(deep,)], "line string")
    assert frame.select(F.size(S.regexp_extract_all(S.col("line"), _WRITER_TOKEN, 0).column)).first()[0] == 3 * depth + 2
    mixed = '{"type":"T","fields":["a",[["b",{"type":"U","fields":[["c"]]}],[]],"d"]}'
    good, *bad = decode(spark, mixed, mixed.replace('"c"]]}]', '"c"]]]}'), mixed + "]}", mixed[:-2], mixed + ',"e"')
    assert list(zip(good.path, good.name)) == [
        ("", "T"), ("1", "a"), ("2", ""), ("2.1", ""), ("2.1.1", "b"), ("2.1.2", "U"), ("2.1.2.1", ""), ("2.1.2.1.1", "c"), ("2.2", ""), ("3", "d"),
    ]
    assert bad == [None] * 4


def test_json_long_and_wide(spark):
    long = "x\\\"" * 200_000
    wide = ",".join(['"w"'] * 3000)
    one, many = decode(spark, '{"type":"T","fields":["%s"]}' % long, '{"type":"T","fields":[%s]}' % wide)
    assert one.name[1] == 'x"' * 200_000
    assert many.path[-1] == "3000" and len(many.name) == 3001


# ---------------------------------------------------------------- text


def test_text_samples(spark):
    plain = evaluate(spark, "sum(one, two)", render, lambda t: name_at(t, "1.0"), lambda t: is_defined(t, 3), lambda t: name_at(t, 0))
    assert plain == ["sum(one, two)", "one", False, "sum"]
    typical = evaluate(spark, TYPICAL, lambda t: render(t, "3.2.1"), lambda t: name_at(t, "3.2.2.2"), lambda t: name_is(t, "3.2.0", "Fn"))
    assert typical == ["shop.Cart.add(int, java.lang.String)", "pears", True]
    deep = evaluate(spark, DEEP, lambda t: name_at(t, "1.2.1.1.1.0"), lambda t: name_at(t, "2.1.2"), lambda t: render(t, 2), lambda t: is_defined(t, "3.1"))
    assert deep == ["dew", "ant", "right(bark(moss, ant), root)", False]
    hollow = evaluate(spark, HOLLOW, render, lambda t: is_defined(t, "1.2"), lambda t: is_defined(t, "2.2"))
    assert hollow[2] is False
    assert evaluate(spark, "((((core))))", lambda t: name_at(t, "1.1.1.1")) == ["core"]
    white = " \t one( \r two ,\n three(\tfour\f) ) \n"
    assert evaluate(spark, white, render, lambda t: name_at(t, "2.1")) == ["one(two, three(four))", "four"]
    marks = "{a;b}([x]=<y>,#$%(^&*,'|'),\"?\")"
    assert evaluate(spark, marks, lambda t: name_at(t, 0), lambda t: name_at(t, 1), lambda t: render(t, 2)) == ["{a;b}", "[x]=<y>", "#$%(^&*, '|')"]
    assert evaluate(spark, "", is_defined, render, lambda t: is_defined(t, 1)) == [False, "", False]


@pytest.mark.parametrize("text", MALFORMED)
def test_text_rejects(spark, text):
    assert rows(trees(spark, text).select("tree")) == [(None,)]


def test_strict_name(spark):
    assert evaluate(spark, "q", lambda t: require_name(t, 0)) == ["q"]
    with pytest.raises(Exception, match="no name"):
        evaluate(spark, TYPICAL, lambda t: require_name(t, 0))


@pytest.mark.parametrize(
    "text, expected",
    [
        ("mix(rye,bake(oven(hot)))", ["mix", "rye", "bake(oven(hot))"]),
        (" f( a , b(c,(d)) ,) ", ["f", "a", "b(c,(d))", ""]),
        ("plain", ["plain"]),
        ("f()", ["f", ""]),
        ("f(a\x01(b,c),d)", ["f", "a\x01(b,c)", "d"]),
        ("f(a)(b)", None),
        ("f(a)b", None),
        ("f(a(b)", None),
        ("f(a))(b)", None),
        ("a,b", None),
        ("a)", None),
    ],
)
def test_shallow_text(spark, text, expected):
    (got,) = rows(spark.createDataFrame([(text,)], "s string").select(tree_from_text_shallow("s").column.alias("t")))
    assert (got[0].name if got[0] else None) == expected


# ---------------------------------------------------------------- rewriting


def test_update(spark):
    soup = "soup(salt,stock(water,bone(marrow, joint)),leek)"
    assert evaluate(spark, soup, lambda t: render(update(t, 2, _leaf("tofu"))), lambda t: render(update(t, 3, subtree(t, "2.2")))) == [
        "soup(salt, tofu, leek)",
        "soup(salt, stock(water, bone(marrow, joint)), bone(marrow, joint))",
    ]
    assert evaluate(spark, "a", lambda t: render(update(t, "", _leaf("b")))) == ["b"]
    assert evaluate(spark, "a(b)", lambda t: render(update(t, 2, _leaf("c"))), lambda t: render(update(t, "1.1", _leaf("c")))) == [
        "a(b)",
        "a(b)",
    ]
    assert evaluate(spark, "a(b(c),d)", lambda t: render(update(t, 1, tree_from_text(S.lit("x(y,z(w))"))))) == ["a(x(y, z(w)), d)"]
    with pytest.raises(Exception, match="cannot replace"):
        evaluate(spark, "a", lambda t: render(update(t, 1, _leaf("b"), strict=True)))


def _leaf(text):
    from spanloom.functions import leaf_tree

    return leaf_tree(S.lit(text))


# ---------------------------------------------------------------- paths, tokens


def test_paths():
    assert node_path("3.1.0").node == "3.1" and node_path("3.1.0").name_only
    assert node_path([0, 1]).nowhere and not node_path("0.0").nowhere
    assert node_path("").node == "" and node_path(3).indexes == (3,)
    with pytest.raises(ValueError):
        node_path([-1])


@pytest.mark.parametrize(
    "text, pattern, expected",
    [
        ("a b", r"\s", ["a", " ", "b"]),
        ("xaxxbx", "x", ["", "x", "a", "x", "", "x", "b", "x", ""]),
        ("abc", "[abc]", ["", "a", "", "b", "", "c", ""]),
        (" test3.14steins;gate x", "[^a-z]+", ["", " ", "test", "3.14", "steins", ";", "gate", " ", "x"]),
        ("none", "x", ["none"]),
    ],
)
def test_tokens(spark, text, pattern, expected):
    assert tokenize(text, pattern) == expected
    (got,) = rows(spark.createDataFrame([(text,)], "s string").select(tokenized("s", pattern).column))
    assert got[0] == expected
