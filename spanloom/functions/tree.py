"""Event trees as ordinary Spark columns.

A tree is ``STRUCT<path ARRAY<STRING>, name ARRAY<STRING>>``: its nodes in
pre-order, the dotted address of each (root ``""``) and its name.  Two flat
string arrays compress well in Parquet (addresses repeat from event to
event), a lookup is one ``array_position`` inside generated code, and the
subtree of a node is always a contiguous slice.

Decoders cut the text into tokens with one regular expression and fold over
them once.  The fold carries where it stands as ``stem`` + ``index`` ("3.2." and
1 is the node 3.2.1) and the addresses seen so far as one string.  A step that
makes no sense makes that string NULL, and NULL sticks, so malformed text ends
as a NULL tree and never as a wrong one.

Lambdas are evaluated as written, without common-subexpression elimination:
whatever is needed twice is bound once, with ``let`` or as a fold field.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from .expr import Expr, S, expr, let
from .paths import NodePath, node_path

TREE_TYPE = "struct<path:array<string>,name:array<string>>"

# What Java calls trimmable: every character up to and including the space.
_BLANKS = "".join(chr(c) for c in range(0x21))
_BLANK = r"[\x00-\x20]"

# Possessive loops: no backtracking and no recursion, however long the string.
_STRING = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
# Tokens follow one another without a gap.  Where a value may begin is told by
# the character before it: the end of another value and a comma, an opening
# bracket, or nothing.  So commas are checked here, and brackets by the fold.
_VALUE = r'\G(?:(?:(?<=[\]}"l]),|(?<=\[)|\A)(?:' + _STRING + r'|\{"type":' + _STRING + r',"fields":\[|null|\['
_WRITER_TOKEN = _VALUE + r")|(?:\]\}?+)++)"
_ANY_TOKEN = _VALUE + r'|\{"fields":\[)|\],"type":' + _STRING + r"\}|\]\}?+)"
# Blanks of JSON stand beside punctuation or at the ends.
_SPACED = "(" + _STRING + r")|[ \t\r\n]*+([\[\]{},:])[ \t\r\n]*+"
_ESCAPES = r"(?:\\u[0-9a-fA-F]{4})++|\\.|[^\\]++"
_LONE = r"\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])|(?<!\\u[dD][89abAB][0-9a-fA-F]{2})\\u[dD][c-fC-F][0-9a-fA-F]{2}"


def _bound(function: Callable[..., Expr]) -> Callable[..., Expr]:
    """Let a function of a tree take a whole expression for it, evaluated once."""

    @functools.wraps(function)
    def call(tree: Expr | str, *args: object, **options: object) -> Expr:
        tree = expr(tree)
        if re.fullmatch(r"[`\w.]+", tree.text):
            return function(tree, *args, **options)
        return let(tree, lambda t: function(t, *args, **options))

    return call


# --------------------------------------------------------------------------
# the fold


def _as(value: object, type_: str) -> Expr:
    return S.lit(value).cast(type_)


def _standing(stem: object, index: object, seen: object, **more: object) -> Expr:
    texts = {name: _as(value, "string") for name, value in more.items()}
    return S.struct(
        stem=_as(stem, "string"), index=_as(index, "int"), seen=_as(seen, "string"), **texts
    )


def _number(index: Expr) -> Expr:
    """An index cut out of an address; none outside the root.  A cast that fails costs as much as the rest of a line."""
    return S.nullif(index, "").cast("int")


def _up(at: Expr, seen: Expr) -> Expr:
    """Leave the current node: "3.2." becomes "3." and 2; the root has no index."""
    parent = S.left(at["stem"], S.length(at["stem"]) - 1)
    index = S.substring_index(parent, ".", -1)
    stem = S.left(parent, S.length(parent) - S.length(index))
    outermost = _standing("", S.lit(None), S.when(at["index"].is_not_null(), seen))
    return S.when(at["stem"] == "", outermost).otherwise(_standing(stem, _number(index), seen))


#: Steps whose addresses are put together before they join those seen so far.
_BLOCK = 64


def _folded(tokens: Expr, start: Expr, step: Callable[[Expr, Expr], Expr], *more: str) -> Expr:
    """Fold all tokens but the first; the addresses seen, NULL when not all is closed in the end.

    ``more`` names what is carried beside stem, index and addresses.

    Every step copies the addresses it adds to.  Blocks keep what is copied
    short, so that a line costs about the length of its addresses.
    """

    def block(at: Expr, number: Expr) -> Expr:
        carried = lambda b: {name: b[name] for name in more}
        inner = S.aggregate(S.slice(tokens, number * _BLOCK + 2, S.lit(_BLOCK)), _standing(at["stem"], at["index"], "", **carried(at)), step)
        return let(inner, lambda b: _standing(b["stem"], b["index"], S.concat(at["seen"], b["seen"]), **carried(b)))

    last = Expr(f"(greatest(size({tokens.text}) - 2, 0) DIV {_BLOCK})")
    return S.aggregate(S.sequence(S.lit(0), last), start, block, lambda at: S.when(at["index"].is_null(), at["seen"]))


def _next(at: Expr) -> Expr:
    return (at["index"] + 1).cast("string")


def _noted(at: Expr, *address: Expr) -> Expr:
    return S.concat(at["seen"], ",", at["stem"], *address)


def _tail(items: Expr) -> Expr:
    return S.slice(items, 2, S.greatest(S.size(items) - 1, 0))


def _tree(paths: Expr, names: Expr) -> Expr:
    return S.struct(path=paths, name=names)


# --------------------------------------------------------------------------
# JSON


def _unescaped(inner: Expr) -> Expr:
    """Text of a JSON string.  Surrogates without their other half become ``?``."""

    def piece(p: Expr) -> Expr:
        # A run of \uXXXX is UTF-16, so pairs of surrogates need no care.
        units = S.replace(S.regexp_replace(p, _LONE, r"\\u003f"), "\\u", "")
        return (
            S.when(~p.startswith("\\"), p)
            .when(p.startswith("\\u"), S.decode(S.unhex(units), "UTF-16BE"))
            .otherwise(S.translate(S.right(p, S.lit(1)), "bfnrt", "\b\f\n\r\t"))
        )

    return S.array_join(S.transform(S.regexp_extract_all(inner, _ESCAPES, 0), piece), "")


def _unescape_all(text: Expr, names: Expr) -> Expr:
    unescape = lambda inner: S.when(inner.contains("\\"), _unescaped(inner)).otherwise(inner)
    return S.when(text.contains("\\"), S.transform(names, unescape)).otherwise(names)


#: Kinds of open brackets: an object, an array, an object whose name comes last.  What closes one has to agree.
_OBJECT, _ARRAY, _LATE = ".", ";", ":"


def _json_fold(tokens: Expr, late: bool) -> Expr:
    """Addresses of all tokens that begin a node, NULL if brackets do not match.

    The kinds of the open brackets, innermost first, are carried beside the
    stem, so that addresses are put together as they are in the end.  A token
    may close several brackets.  With ``late``, objects may have their name
    behind their children, each token closes one bracket, and what closes one
    is noted as "!" and its stem.
    """

    def kind(token: Expr) -> Expr:
        opened = S.when(token == "[", _ARRAY)
        if late:
            opened = opened.when(token == '{"fields":[', _LATE)
        return opened.when(token.startswith('{"type":'), _OBJECT)

    def closes(token: Expr) -> Expr:
        closed = S.replace(S.replace(token, "]}", _OBJECT), "]", _ARRAY)
        return S.when(token.startswith('],"type":'), _LATE).otherwise(closed) if late else closed

    def up(at: Expr, closed: Expr) -> Expr:
        seen = S.concat(at["seen"], ",!", at["stem"]) if late else at["seen"]
        matching = S.when(at["kinds"].startswith(closed), seen)
        # From the index of the last node that is closed on.
        tail = S.substring_index(at["stem"], ".", S.lit(-1) - S.length(closed))

        def left(open_: Expr) -> Expr:
            stem = S.left(at["stem"], S.length(at["stem"]) - S.length(open_["tail"]))
            index = _number(S.substring_index(open_["tail"], ".", 1))
            outermost = _standing("", S.lit(None), matching, kinds="")
            return S.when(open_["kinds"] == "", outermost).otherwise(_standing(stem, index, matching, kinds=open_["kinds"]))

        return let(S.struct(kinds=S.substring(at["kinds"], S.length(closed) + 1), tail=tail), left)

    def step(at: Expr, token: Expr) -> Expr:
        leaf = _standing(at["stem"], at["index"] + 1, _noted(at, _next(at)), kinds=at["kinds"])
        stem = S.concat(at["stem"], _next(at), ".")
        down = _standing(stem, 0, _noted(at, _next(at)), kinds=S.concat(kind(token), at["kinds"]))
        # Most tokens are strings, so these are told apart first.
        return (
            S.when(token.startswith('"') | (token == "null"), leaf)
            .when(token.startswith("]"), let(closes(token), lambda closed: up(at, closed)))
            .otherwise(down)
        )

    first = S.get(tokens, 0)
    # A leaf at the root is over at once; what closes nothing cannot come first.
    start = (
        S.when(first.startswith('"') | (first == "null"), _standing("", S.lit(None), "", kinds=""))
        .when(first.startswith("]"), _standing("", S.lit(None), S.lit(None), kinds=""))
        .otherwise(_standing("", 0, "", kinds=kind(first)))
    )
    return _folded(tokens, start, step, "kinds")


def _addresses(seen: Expr) -> Expr:
    return S.split(seen, ",", -1)


def _tokens(text: Expr, pattern: str, body: Callable[[Expr], Expr]) -> Expr:
    """``body`` of the tokens, without their commas, if they make up the whole text."""

    def whole(found: Expr) -> Expr:
        complete = S.octet_length(S.array_join(found, "")) == S.octet_length(text)
        plain = S.transform(found, lambda t: Expr(f"trim(LEADING ',' FROM {t.text})"))
        return S.when(complete, let(plain, body))

    return let(S.regexp_extract_all(text, pattern, 0), whole)


def _inner(token: Expr, frame: int = 2) -> Expr:
    """What is within the quotes of a string token, or of one within a frame of so many characters."""
    return S.substring(token, 2 if frame == 2 else len('{"type":"') + 1, S.length(token) - frame)


_HEAD = len('{"type":"","fields":[')


def _from_writer_order(text: Expr) -> Expr:
    def name(token: Expr) -> Expr:
        return (
            S.when(token.startswith('"'), _inner(token))
            .when(token == "[", "")
            .when(token == "null", token)
            .otherwise(_inner(token, _HEAD))
        )

    def build(tokens: Expr) -> Expr:
        names = S.transform(S.filter(tokens, lambda t: ~t.startswith("]")), name)
        return let(
            _json_fold(tokens, late=False),
            lambda seen: S.when(seen.is_not_null(), _tree(_addresses(seen), _unescape_all(text, names))),
        )

    return _tokens(text, _WRITER_TOKEN, build)


def _from_any_order(text: Expr) -> Expr:
    """Decode JSON in which an object's name may follow its children: ``{"fields":[…],"type":…}``."""

    def build(tokens: Expr) -> Expr:
        def finish(seen: Expr) -> Expr:
            def name(address: Expr, token: Expr) -> Expr:
                note = S.concat("!", S.when(address != "", S.concat(address, ".")).otherwise(""))
                close = S.get(tokens, S.array_position(seen, note).cast("int") - 1)
                return (
                    S.when(token == "null", token)
                    .when(token.startswith('"'), _inner(token))
                    .when(token == "[", "")
                    .when(token.startswith('{"type":'), _inner(token, _HEAD))
                    .otherwise(S.regexp_extract(close, r'(?s)^\],"type":"(.*)"\}$', 1))
                )

            nodes = S.filter(
                S.zip_with(seen, tokens, lambda a, t: S.when(~t.startswith("]"), S.struct(path=a, name=name(a, t)))),
                lambda n: n.is_not_null(),
            )
            return let(nodes, lambda n: _tree(n["path"], _unescape_all(text, n["name"])))

        return let(_json_fold(tokens, late=True), lambda seen: S.when(seen.is_not_null(), let(_addresses(seen), finish)))

    return _tokens(text, _ANY_TOKEN, build)


def tree_from_json(text: Expr | str) -> Expr:
    """Decode one JSON trace line; NULL when it is not a well-formed event.

    Strings, null, ``{"type", "fields"}`` objects and bare arrays are the only
    accepted values; the two keys are written as they are, in either order.
    Depth and length have no limit but that of a row.  Lines laid out as the
    tracer writes them are read as they stand; those with other spacing or
    order of keys are stripped of blanks first.
    """
    stripped = lambda t: S.trim(S.regexp_replace(t, _SPACED, "$1$2"))
    # Bound, because the optimizer would put what makes the text in each place that reads it.
    return let(expr(text), lambda t: S.coalesce(_from_writer_order(t), let(stripped(t), _from_any_order)))


# --------------------------------------------------------------------------
# name(arg, arg(...)) text


def _trim(text: Expr) -> Expr:
    return S.btrim(text, _BLANKS)


def tree_from_text(text: Expr | str) -> Expr:
    """Decode ``name(arg, arg(arg))`` to any depth; NULL when ill-formed."""
    text = expr(text)
    # Each token is a delimiter and the text up to the next one; the text after
    # "(" or "," names the node that delimiter begins.
    tokens = S.regexp_extract_all(S.concat(",", text), r"[(),][^(),]*+", 0)

    def step(at: Expr, token: Expr) -> Expr:
        inside = _standing(
            S.concat(at["stem"], at["index"].cast("string"), "."),
            1,
            _noted(at, at["index"].cast("string"), ".1"),
        )
        below_root = _standing("", 1, S.concat(at["seen"], ",1"))
        return (
            S.when(token.startswith(","), _standing(at["stem"], at["index"] + 1, _noted(at, _next(at))))
            .when(token.startswith(")"), _up(at, at["seen"]))
            .when(at["index"].is_null(), below_root)
            .otherwise(inside)
        )

    def build(ts: Expr) -> Expr:
        names = S.transform(
            S.filter(ts, lambda t: ~t.startswith(")")),
            lambda t: _trim(S.substring(t, 2, S.length(t))),
        )
        return let(_folded(ts, _standing("", S.lit(None), ""), step), lambda all_: S.when(all_.is_not_null(), _tree(S.split(all_, ",", -1), names)))

    # After a closing parenthesis only "," or ")" may follow.
    stray = text.rlike(r"\)" + _BLANK + r"*+[^\x00-\x20,)]")
    return S.when(~stray, let(tokens, build))


def _split_arguments(inner: Expr) -> Expr:
    """Cut at the commas outside parentheses; NULL when these do not match up."""
    # The cuts are marked as \x01b in the folded text, a literal \x01 as \x01a.
    tokens = S.regexp_extract_all(
        S.concat("(", S.replace(inner, "\x01", "\x01a")),
        r"[(),][^(),]*+",
        0,
    )
    at = lambda depth, text: S.struct(depth=depth.cast("int"), text=text)

    def step(acc: Expr, token: Expr) -> Expr:
        text = S.concat(acc["text"], token)
        cut = S.concat(acc["text"], "\x01b", S.substring(token, 2, S.length(token)))
        return (
            S.when(token.startswith("("), at(acc["depth"] + 1, text))
            .when(token.startswith(")"), at(S.when(acc["depth"] > 0, acc["depth"] - 1), text))
            .when(acc["depth"] == 0, at(acc["depth"], cut))
            .otherwise(at(acc["depth"], text))
        )

    def build(ts: Expr) -> Expr:
        start = at(S.lit(0), S.substring(S.get(ts, 0), 2, S.length(inner) * 2))
        marked = S.aggregate(_tail(ts), start, step, lambda acc: S.when(acc["depth"] == 0, acc["text"]))
        return S.transform(
            S.split(marked, "\x01b", -1), lambda s: S.replace(s, "\x01a", "\x01")
        )

    return S.when(inner.rlike("[()]"), let(tokens, build)).otherwise(S.split(inner, ",", -1))


def tree_from_text_shallow(text: Expr | str) -> Expr:
    """Decode only the outermost ``name(arg, …)``; arguments stay text leaves."""
    text = expr(text)

    def arguments(t: Expr, head: Expr) -> Expr:
        inner = S.substring(t, S.length(head) + 2, S.length(t) - S.length(head) - 2)
        return S.when(t.endswith(")"), let(inner, _split_arguments))

    def build(t: Expr) -> Expr:
        head = S.substring_index(t, "(", 1)
        names = let(head, lambda h: S.when(~h.rlike("[),]"), S.concat(S.array(h), arguments(t, h))))
        paths = lambda n: S.transform(n, lambda _n, i: S.when(i == 0, "").otherwise(i.cast("string")))
        compound = let(names, lambda n: S.when(n.is_not_null(), _tree(paths(n), S.transform(n, _trim))))
        return S.when(t.contains("("), compound).when(~t.rlike("[),]"), leaf_tree(t))

    return let(_trim(text), build)


# --------------------------------------------------------------------------
# reading


def _position(tree: Expr, node: Expr) -> Expr:
    return S.array_position(tree["path"], node).cast("int")


def _below(tree: Expr, node: Expr) -> Expr:
    """How many nodes lie under ``node`` (not the root)."""
    return S.size(S.filter(tree["path"], lambda p: p.startswith(S.concat(node, "."))))


def _label(tree: Expr, node: Expr) -> Expr:
    """Name of a node: empty for an empty one, NULL for a missing one."""
    return S.get(tree["name"], _position(tree, node) - 1)


@_bound
def name_in(tree: Expr | str, node: Expr) -> Expr:
    """Name of the node whose address is in a column; NULL for an empty or missing one."""
    return S.nullif(_label(tree, node), "")


@_bound
def name_at(tree: Expr | str, path) -> Expr:
    """Name of the addressed node; NULL for an empty or missing one."""
    at = node_path(path)
    if at.nowhere:
        return S.lit(None).cast("string")
    return name_in(tree, S.lit(at.node))


@_bound
def require_name(tree: Expr | str, path) -> Expr:
    """Like :func:`name_at`, but an empty or missing node fails the query."""
    at = node_path(path)
    return S.coalesce(
        name_at(tree, at), S.raise_error(S.lit(f"no name at path {at.node or '<root>'}")).cast("string")
    )


@_bound
def name_is(tree: Expr | str, path, *names: str) -> Expr:
    """Whether the addressed node has one of these names (never NULL)."""
    at, wanted = node_path(path), [n for n in names if n]
    if at.nowhere or not wanted:
        return S.lit(False)
    return S.coalesce(_label(tree, S.lit(at.node)).isin(*wanted), False)


def _subtree(tree: Expr, node: Expr) -> Expr:
    def cut(first: Expr) -> Expr:
        count = S.when(first > 0, _below(tree, node) + 1).otherwise(0)
        paths = S.transform(
            S.slice(tree["path"], S.greatest(first, 1), count),
            lambda p: S.substring(p, S.length(node) + 2, S.length(p)),
        )
        return _tree(paths, S.slice(tree["name"], S.greatest(first, 1), count))

    return let(_position(tree, node), cut)


@_bound
def subtree(tree: Expr | str, path) -> Expr:
    """The addressed subtree as a tree of its own; a missing node is an empty tree."""
    at = node_path(path)
    if at.name_only or at.nowhere:
        return leaf_tree(S.coalesce(name_at(tree, at), ""))
    if not at.node:
        return tree
    found = let(_subtree(tree, S.lit(at.node)), lambda t: S.when(S.size(t["path"]) > 0, t))
    return S.coalesce(found, leaf_tree(""))


@_bound
def is_defined(tree: Expr | str, path="") -> Expr:
    """Whether the addressed node or anything under it has a name."""
    at = node_path(path)
    if at.nowhere:
        return S.lit(False)
    named = S.coalesce(_label(tree, S.lit(at.node)), "") != ""
    if at.name_only or at.nowhere:
        return named
    return named | has_children(tree, at)


@_bound
def has_children(tree: Expr | str, path="") -> Expr:
    """Whether anything *under* the addressed node has a name."""
    at = node_path(path)
    if at.name_only or at.nowhere:
        return S.lit(False)
    start = at.node + "." if at.node else ""
    pairs = S.zip_with(
        tree["path"],
        tree["name"],
        lambda p, n: (n != "") & p.startswith(start) & (p != ""),
    )
    return S.exists(pairs, lambda hit: hit)


# --------------------------------------------------------------------------
# text output


def _depth(path: Expr) -> Expr:
    dots = S.length(path) - S.length(S.replace(path, ".", ""))
    return S.when(path == "", 0).otherwise(dots + 1)


def _visible(tree: Expr) -> Expr:
    """Drop what hangs below a node under which nothing has a name."""

    def parent_prefix(path: Expr) -> Expr:
        return S.left(path, S.length(path) - S.length(S.substring_index(path, ".", -1)))

    def prune(t: Expr) -> Expr:
        named = S.filter(
            S.zip_with(t["path"], t["name"], lambda p, n: S.when(n != "", p)),
            lambda p: p.is_not_null() & (p != ""),
        )

        def keep(names: Expr) -> Expr:
            # A node shows when it is the root or has a named node beside or below it.
            shown = lambda p: (p == "") | let(
                parent_prefix(p), lambda prefix: S.exists(names, lambda q: q.startswith(prefix))
            )
            kept = S.filter(
                S.zip_with(
                    t["path"],
                    t["name"],
                    lambda p, n: S.when(shown(p), S.struct(path=p, name=n)),
                ),
                lambda s: s.is_not_null(),
            )
            return let(kept, lambda k: _tree(k["path"], k["name"]))

        return let(named, keep)

    # Without an unnamed node every parent has a named child: nothing to drop.
    return S.when(S.array_contains(tree["name"], ""), prune(tree)).otherwise(tree)


def _join(tree: Expr) -> Expr:
    def text(t: Expr) -> Expr:
        def link(here: Expr, after: Expr) -> Expr:
            return (
                S.when(after.is_null(), S.repeat(")", here - S.get(t["depth"], 0)))
                .when(after > here, "(")
                .when(after == here, ", ")
                .otherwise(S.concat(S.repeat(")", here - after), ", "))
            )

        links = S.zip_with(t["depth"], _tail(t["depth"]), link)
        return S.array_join(S.zip_with(t["name"], links, lambda n, l: S.concat(n, l)), "")

    depths = S.transform(tree["path"], _depth)
    return let(S.struct(depth=depths, name=tree["name"]), text)


def _render_whole(tree: Expr) -> Expr:
    unnamed = S.array_contains(tree["name"], "")
    return (
        S.when(S.size(tree["name"]) == 1, S.get(tree["name"], 0))
        .when(unnamed, let(_visible(tree), _join))
        .otherwise(_join(tree))
    )


@_bound
def render_at(tree: Expr | str, node: Expr) -> Expr:
    """Compact text of the subtree whose address is in a column."""
    follower = S.get(tree["path"], _position(tree, node))
    inside = S.when(node == "", S.size(tree["path"]) > 1).otherwise(
        S.coalesce(follower.startswith(S.concat(node, ".")), False)
    )
    whole = S.when(node == "", tree).otherwise(_subtree(tree, node))
    return S.when(inside, let(whole, _render_whole)).otherwise(
        S.coalesce(_label(tree, node), "")
    )


@_bound
def render(tree: Expr | str, path="") -> Expr:
    """Compact text ``name(child, child)`` of the addressed subtree (missing: ``""``)."""
    at = node_path(path)
    if at.nowhere:
        return S.lit("")
    if at.name_only:
        return S.coalesce(_label(tree, S.lit(at.node)), "")
    return render_at(tree, S.lit(at.node)) if at.node else _render_whole(tree)


@_bound
def debug_text(tree: Expr | str) -> Expr:
    """One line per visible node: address, dots up to a depth-dependent column, name."""

    def line(path: Expr, after: Expr) -> Expr:
        room = _depth(path) * 2 + 8 - S.length(path)
        dots = lambda used: S.repeat(".", S.greatest(room - used, 0))
        parent = S.when(path == "", after.is_not_null()).otherwise(
            S.coalesce(after.startswith(S.concat(path, ".")), False)
        )
        return S.when(
            parent,
            S.when(path == "", S.concat("0", dots(1))).otherwise(
                S.concat(path, ".0", dots(2))
            ),
        ).otherwise(S.concat(path, dots(0)))

    def lines(t: Expr) -> Expr:
        labels = S.zip_with(t["path"], _tail(t["path"]), line)
        return S.array_join(S.zip_with(labels, t["name"], lambda l, n: S.concat(l, n)), "\n")

    return let(_visible(tree), lines)


# --------------------------------------------------------------------------
# rewriting


def leaf_tree(text: Expr) -> Expr:
    return _tree(S.array(""), S.array(text))


def update_in(tree: Expr, node: Expr, replacement: Expr, missing: Expr) -> Expr:
    """Replace the subtree whose address (not the root) is in a column.

    ``missing`` is the result when there is no such node or no replacement.
    """

    def splice(position: Expr, new: Expr) -> Expr:
        after = position + 1 + _below(tree, node)
        rest = S.greatest(S.size(tree["path"]) - after + 1, 0)
        rebased = S.transform(
            new["path"], lambda p: S.when(p == "", node).otherwise(S.concat(node, ".", p))
        )
        around = lambda items, middle: S.concat(
            S.slice(items, 1, position - 1), middle, S.slice(items, after, rest)
        )
        return _tree(around(tree["path"], rebased), around(tree["name"], new["name"]))

    return let(
        S.struct(position=_position(tree, node), new=replacement),
        lambda b: S.when(
            (b["position"] > 0) & b["new"].is_not_null(), splice(b["position"], b["new"])
        ).otherwise(missing),
    )


@_bound
def rename_leaf(tree: Expr | str, path, name: Expr) -> Expr:
    """Replace the addressed node by a leaf; in the usual case that it is one, only its name changes."""
    at = node_path(path)
    position = _position(tree, S.lit(at.node))
    beside = S.coalesce(S.get(tree["path"], position), "").startswith(at.node + ".")
    names = S.concat(
        S.slice(tree["name"], 1, position - 1),
        S.array(name),
        S.slice(tree["name"], position + 1, S.size(tree["name"])),
    )
    return S.when((position > 1) & ~beside, _tree(tree["path"], names)).otherwise(
        update(tree, at, leaf_tree(name))
    )


@_bound
def update(tree: Expr | str, path, replacement: Expr, strict: bool = False) -> Expr:
    """Replace the addressed subtree by another tree.

    When the node does not exist or the replacement is NULL the tree is
    returned unchanged, or the query fails if ``strict``.
    """
    at = node_path(path)
    if at.name_only:
        raise ValueError("only whole nodes can be replaced, not their names")
    missing = _fail(at) if strict else tree
    if not at.node:
        return S.coalesce(replacement, missing)
    return update_in(tree, S.lit(at.node), replacement, missing)


def _fail(at: NodePath) -> Expr:
    return S.raise_error(S.lit(f"cannot replace node {at.node or '<root>'}")).cast(TREE_TYPE)
