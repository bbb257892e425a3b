"""Structural index of many JSON texts at once: quote, bracket and delimiter bitmaps, depths by prefix sums, value spans."""

from __future__ import annotations

import json
import re

import numpy as np

OPEN_OBJECT, CLOSE_OBJECT, OPEN_ARRAY, CLOSE_ARRAY, COLON, COMMA, STRING, SCALAR = range(1, 9)
_KIND = np.zeros(256, np.int8)
_KIND[[ord(c) for c in "{}[]:,"]] = range(1, 7)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
_ESCAPES = np.zeros(256, bool)
_ESCAPES[[ord(c) for c in '"\\/bfnrtu']] = True
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
#: Bytes of scalars that are compared together.
_WIDTH = 24
_PLAIN = re.compile(rb"true|false|null|-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")


class JsonIndex:
    """Tokens of all ``texts`` in order, as parallel arrays.

    ``kind`` and ``doc`` of each token; ``start`` and ``end`` of its bytes in ``data`` (a container's end is that of its
    closing bracket); ``parent``, the token of the container that holds it (-1 at the top); ``pos``, its element or member
    number there; ``key``, the token of its member name in an object (-1 else). ``is_value`` marks tokens that begin a
    value. ``root`` has each text's value token, -1 where the text is null or not wholly JSON (RFC 8259).
    """

    def __init__(self, texts: list[str | None]):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = b"".join(r + b"\n" for r in raw)
        b = np.frombuffer(self.data, np.uint8)
        n, count = len(b), len(raw)
        size = np.fromiter((len(r) + 1 for r in raw), np.int64, count)
        del raw
        place = np.int32 if n < 1 << 31 else np.int64  # of the arrays that have an entry a byte
        bounds = np.concatenate([[0], np.cumsum(size)]).astype(place)
        self.count, at = count, np.arange(n, dtype=place)
        doc_of = np.repeat(np.arange(count, dtype=place), size)
        base = bounds[doc_of]
        bad = np.zeros(count, bool)

        # quotes that no backslash escapes: a character is escaped after an odd run of backslashes within its text
        slash = b == 0x5C
        run = np.where(slash, place(-1), at)
        np.maximum.accumulate(run, out=run)
        run[1:] = run[:-1].copy()
        run[:1] = -1
        run = at - np.maximum(run, base - 1, out=run) - 1
        escaped = (run % 2 == 1) & (at > base)
        del run, at
        quote = (b == 0x22) & ~escaped
        total = np.cumsum(quote, dtype=place)
        parity = ((total - (total - quote)[base]) % 2).astype(np.int8)
        del total, base
        inside = (parity == 1) | quote  # a string with both its quotes
        ends = bounds[1:] - 1
        bad |= parity[ends] == 1
        bad[doc_of[slash & ~inside]] = True
        bad[doc_of[inside & (b < 0x20)]] = True
        esc = np.flatnonzero(escaped & (parity == 1) | escaped & (b == 0x22))
        bad[doc_of[esc[~_ESCAPES[b[esc]]]]] = True
        uni = esc[b[esc] == ord("u")]
        if len(uni):
            four = np.minimum(uni[:, None] + np.arange(1, 5), n - 1)
            bad[doc_of[uni[~_HEX[b[four]].all(1)]]] = True

        # tokens: structural characters, opening quotes and the first bytes of scalars, all outside strings
        kinds = np.where(inside, np.int8(0), _KIND[b])
        kinds[quote & (parity == 1)] = STRING
        scalar = ~inside & (kinds == 0) & ~_SPACE[b]
        first = scalar & ~np.concatenate([[False], scalar[:-1]])
        kinds[first] = SCALAR
        start = np.flatnonzero(kinds)
        kind, doc = kinds[start], doc_of[start].astype(np.int64)
        end = start + 1
        closing = np.flatnonzero(quote & (parity == 0))
        strings = np.flatnonzero(kind == STRING)
        after = np.searchsorted(closing, start[strings])
        end[strings] = np.where(after < len(closing), closing[np.minimum(after, len(closing) - 1)] + 1 if len(closing) else 0, n)
        scalars = np.flatnonzero(kind == SCALAR)
        lasts = np.flatnonzero(scalar & ~np.concatenate([scalar[1:], [False]]))
        end[scalars] = lasts[np.searchsorted(lasts, start[scalars])] + 1 if len(scalars) else 0
        del quote, inside, parity, escaped, slash, kinds, scalar, first, doc_of
        short = scalars[end[scalars] - start[scalars] <= _WIDTH]
        words, which = np.unique(self._words(start[short], end[short]), return_inverse=True)
        plain = np.array([bool(_PLAIN.fullmatch(w)) for w in words.tolist()], bool)
        bad[doc[short[~plain[which]]]] = True
        for i in scalars[end[scalars] - start[scalars] > _WIDTH]:
            if not _PLAIN.fullmatch(self.data[start[i] : end[i]]):
                bad[doc[i]] = True

        # depth by prefix sums; level: the depth of the container that a token opens, closes or stands in
        opens, closes = (kind == OPEN_OBJECT) | (kind == OPEN_ARRAY), (kind == CLOSE_OBJECT) | (kind == CLOSE_ARRAY)
        step = opens.astype(np.int64) - closes
        depth = np.cumsum(step)
        token_base = np.searchsorted(doc, doc, "left") if len(doc) else doc
        depth -= np.concatenate([[0], depth])[token_base] if len(doc) else 0
        if len(doc):
            bad[doc[depth < 0]] = True
            lasts_of = np.searchsorted(doc, np.arange(count), "right") - 1
            has = (lasts_of >= 0) & (doc[np.maximum(lasts_of, 0)] == np.arange(count))
            bad[~has] = True
            bad[has] |= depth[lasts_of[has]] != 0
        else:
            bad[:] = True
        level = np.where(closes, depth + 1, depth)

        # within each level, in order: the last opening bracket is the container of what follows it
        t = np.arange(len(kind))
        order = np.lexsort((t, level))
        held = np.maximum.accumulate(np.where(opens[order], np.arange(len(order)), -1)) if len(order) else order
        container = np.full(len(kind), -1)
        container[order] = np.where(held >= 0, order[np.maximum(held, 0)], -1)
        bad_at = lambda mask: bad.__setitem__(doc[mask], True)
        usable = ~bad[doc] if len(doc) else np.zeros(0, bool)
        match = closes & usable
        bad_at(match & ((kind[container] - kind) != -1))
        lvl = np.where(opens, level - 1, level)  # an opening bracket itself stands in the level above
        parent = np.full(len(kind), -1)
        parent[~opens] = np.where(level[~opens] > 0, container[~opens], -1)
        if len(kind):
            # opening brackets: find the last opener of their outer level before them
            openers = np.flatnonzero(opens)
            for_level = np.lexsort((openers, level[openers]))
            sorted_open, sorted_level = openers[for_level], level[openers][for_level]
            want = level[openers] - 1
            keys = sorted_level * np.int64(len(kind) + 1) + sorted_open
            hit = np.searchsorted(keys, want * np.int64(len(kind) + 1) + openers) - 1
            ok = (hit >= 0) & (want > 0)
            ok &= np.where(ok, sorted_level[np.maximum(hit, 0)] == want, False)
            parent[openers] = np.where(ok, sorted_open[np.maximum(hit, 0)], -1)
            parent[closes] = container[closes]
            shut = np.flatnonzero(closes & usable)
            end[container[shut]] = start[shut] + 1

        # grammar: what may stand beside what, given the container
        inner = np.where(closes, -2, parent)
        holder = np.where(inner >= 0, kind[np.maximum(inner, 0)], 0)
        prev = np.concatenate([[0], kind[:-1]])
        same_doc = np.concatenate([[False], doc[1:] == doc[:-1]]) if len(doc) else np.zeros(0, bool)
        prev = np.where(same_doc, prev, 0)
        nxt = np.where(np.concatenate([same_doc[1:], [False]]), np.concatenate([kind[1:], [0]]), 0)
        value_like = opens | (kind == STRING) | (kind == SCALAR)
        ended = np.isin(prev, (CLOSE_OBJECT, CLOSE_ARRAY, STRING, SCALAR))
        is_key = (kind == STRING) & (holder == OPEN_OBJECT) & np.isin(prev, (OPEN_OBJECT, COMMA))
        bad_at(is_key & (nxt != COLON))
        prev_key = np.where(same_doc, np.concatenate([[False], is_key[:-1]]), False) if len(kind) else is_key
        bad_at((kind == COLON) & ~prev_key)
        bad_at(value_like & ~is_key & (holder == OPEN_OBJECT) & (prev != COLON))
        bad_at(value_like & (holder == OPEN_ARRAY) & ~np.isin(prev, (OPEN_ARRAY, COMMA)))
        bad_at(value_like & (holder == 0) & same_doc)
        bad_at((kind == COMMA) & ((holder == 0) | ~ended))
        bad_at((kind == COMMA) & prev_key)
        bad_at((kind == CLOSE_OBJECT) & ~((prev == OPEN_OBJECT) | ended & ~prev_key))
        bad_at((kind == CLOSE_ARRAY) & ~((prev == OPEN_ARRAY) | ended))
        bad_at(((kind == COLON) & (holder == 0)))

        self.kind, self.doc, self.start, self.end, self.parent = kind, doc, start, end, parent
        self.is_value = value_like & ~is_key
        self.key = np.where((prev == COLON) & self.is_value, t - 2, -1)
        # commas of a level so far, less those before the container opened
        opened = mine = np.zeros(len(kind), np.int64)
        if len(kind):
            comma_tokens = np.flatnonzero(kind == COMMA)
            codes = np.sort(lvl[comma_tokens] * np.int64(len(kind) + 1) + comma_tokens)
            upto = lambda lv, tok: np.searchsorted(codes, lv * np.int64(len(kind) + 1) + tok)
            opened = upto(lvl, np.maximum(parent, 0))
            mine = upto(lvl, t)
        self.pos = np.where(parent >= 0, mine - opened, 0)
        self.root = np.full(count, -1, np.int64)
        tops = np.flatnonzero(self.is_value & (parent < 0))
        self.root[doc[tops]] = tops
        self.root[bad] = -1
        children = np.flatnonzero(self.is_value & (parent >= 0))
        self._children = children[np.argsort(parent[children], kind="stable")]
        self._sorted_parent = parent[self._children]

    def _words(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The bytes of short spans as one array of fixed width."""
        b, place = np.frombuffer(self.data, np.uint8), start[:, None] + np.arange(_WIDTH)
        own = place < end[:, None]
        return np.where(own, b[np.minimum(place, len(b) - 1)], 0).astype(np.uint8).reshape(-1).view(f"S{_WIDTH}")

    def named(self, tokens: np.ndarray, name: str) -> np.ndarray:
        """Whether each member name is ``name``; only those with escapes are read one by one."""
        start, end = self.start[tokens] + 1, self.end[tokens] - 1
        raw = np.frombuffer(name.encode("utf-8", "surrogatepass"), np.uint8)
        b, same = np.frombuffer(self.data, np.uint8), end - start == len(raw)
        same[same] = (b[start[same][:, None] + np.arange(len(raw))] == raw).all(1)
        slashes = np.flatnonzero(b == 0x5C)
        if len(slashes):
            escaped = np.searchsorted(slashes, end) > np.searchsorted(slashes, start)
            same[escaped] = [json.loads(self.text(t)) == name for t in tokens[escaped]]
        return same

    def text(self, token: int) -> str:
        return self.data[self.start[token] : self.end[token]].decode("utf-8", "surrogatepass")

    def children(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``tokens``, child token) of every value held directly by them."""
        lo, hi = np.searchsorted(self._sorted_parent, tokens, "left"), np.searchsorted(self._sorted_parent, tokens, "right")
        size = hi - lo
        which = np.repeat(np.arange(len(tokens)), size)
        return which, self._children[np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]


class Values:
    """JSON values with the row each belongs to and its place; they may lie in several indexes."""

    def __init__(self, parts: list[tuple[JsonIndex, np.ndarray, np.ndarray, np.ndarray]]):
        self.parts = parts

    @classmethod
    def parse(cls, texts: list[str | None]) -> Values:
        """The values of the texts that are JSON, rows numbered as given; a string that holds JSON counts as that JSON."""
        index = JsonIndex(texts)
        rows = np.flatnonzero(index.root >= 0)
        return cls([(index, rows, index.root[rows], np.zeros(len(rows), np.int64))]).unwrapped()

    def unwrapped(self) -> Values:
        """Strings replaced by the JSON that they hold, again and again; those that hold none are left out."""
        done, todo = [], list(self.parts)
        while todo:
            index, rows, tokens, pos = todo.pop()
            wrapped = index.kind[tokens] == STRING
            done.append((index, rows[~wrapped], tokens[~wrapped], pos[~wrapped]))
            if wrapped.any():
                inner = JsonIndex([json.loads(index.text(t)) for t in tokens[wrapped]])
                ok = inner.root >= 0
                todo.append((inner, rows[wrapped][ok], inner.root[ok], pos[wrapped][ok]))
        return Values([p for p in done if len(p[1])])

    def member(self, name: str) -> Values:
        """The member ``name`` of each object (its last, if repeated), at the object's row and place, unwrapped."""
        out = []
        for index, rows, tokens, pos in self.parts:
            objects = np.flatnonzero(index.kind[tokens] == OPEN_OBJECT)
            which, child = index.children(tokens[objects])
            named = index.named(index.key[child], name)
            which, child = which[named], child[named]
            last = np.concatenate([which[1:] != which[:-1], [True]]) if len(which) else np.zeros(0, bool)
            out.append((index, rows[objects][which[last]], child[last], pos[objects][which[last]]))
        return Values([p for p in out if len(p[1])]).unwrapped()

    def elements(self) -> Elements:
        """Each object in the arrays; an object in place of an array is an array of one; other elements give nothing but
        keep their place."""
        out = []
        for index, rows, tokens, pos in self.parts:
            kinds = index.kind[tokens]
            one = np.flatnonzero(kinds == OPEN_OBJECT)
            arrays = np.flatnonzero(kinds == OPEN_ARRAY)
            which, child = index.children(tokens[arrays])
            keep = index.kind[child] == OPEN_OBJECT
            many, child = arrays[which[keep]], child[keep]
            both = np.concatenate([one, many])
            out.append((index, rows[both], pos[both], np.concatenate([np.zeros(len(one), np.int64), index.pos[child]]),
                np.concatenate([tokens[one], child])))
        return Elements([p for p in out if len(p[1])])


class Elements:
    """Objects of arrays by index: the row, the place of the array's value, the place in the array and the token of each."""

    def __init__(self, parts: list[tuple[JsonIndex, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.parts = parts

    def values(self) -> Values:
        """The objects as values, their place in the array as place."""
        return Values([(index, rows, tokens, pos) for index, rows, _, pos, tokens in self.parts])
