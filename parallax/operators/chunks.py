"""The exact search behind `lepod.fewest_chunks`: fewest chunks, then fewest crossings, of all matchings of equal tokens
with as many links as there can be.

A matching is taken as given; the search returns a better one, or that one where none is better.  It goes over the
left side from token to token.  Nothing is capped; what is left out cannot lead to a better matching:

* links of tokens that have one choice only are known before (`fixed`), so are those of a token that stands as often
  on both sides and next to no neighbour that it has on the other side too: two crossing links of a token outside every run
  of neighbours are better exchanged;
* for the same reason a link crosses an earlier one of its token only if either is in such a run;
* states whose rest is the same (what may still be used, and what it crosses) are one state, the best;
* a state goes if a lower bound of its result is no better than the best matching known.

At most WIDE states are followed together, the others wait on a stack, so memory is bounded by WIDE times the length.  The
problem is NP-hard: a pair with many repeated tokens on both sides can take very long.
"""
from __future__ import annotations

from collections import Counter

WIDE = 4096  # states that are followed together
FIRST = 64  # of a first pass that only looks for a good matching


def measure(links: list[tuple[int, int]]) -> tuple[int, int]:
    """(chunks, crossings) of links in the order of the left side."""
    chunks = crossings = used = 0
    last = (-2, -2)
    for i, j in links:
        chunks += (i - 1, j - 1) != last
        crossings += (used >> (j + 1)).bit_count()
        used |= 1 << j
        last = (i, j)
    return chunks, crossings


def improved(left: list[tuple], right: list[tuple], links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The best matching of the (place, token) that both sides have; `links` is any of the largest, and stays if it is best."""
    search = _Search(left, right, links)
    if search.possible():
        search.run(FIRST, all_states=False)
        search.run(WIDE, all_states=True)
    return search.links


class _Search:
    def __init__(self, left: list[tuple], right: list[tuple], links: list[tuple[int, int]]):
        self.left, self.links, self.best, self.total = left, links, measure(links), len(links)
        self.own, self.places = {}, {}  # token -> where it stands
        for side, where in ((left, self.own), (right, self.places)):
            for at, w in side:
                where.setdefault(w, []).append(at)
        self.mask = {w: sum(1 << j for j in js) for w, js in self.places.items()}
        self._neighbours(right)
        own, places = self.own, self.places
        self.fixed: dict[int, int] = {}
        for w in own:
            if len(own[w]) == len(places[w]) and (w not in self.near or len(own[w]) == 1):
                self.fixed.update(zip(own[w], places[w]))
        self.free = [w for w in own if own[w][0] not in self.fixed]
        self.need = {w: min(len(own[w]), len(places[w])) for w in self.free}
        self.base = measure(sorted(self.fixed.items()))[1]

    def _neighbours(self, right: list[tuple]) -> None:
        left, n = self.left, len(self.left)
        pairs = lambda side: [(a[1], b[1]) if b[0] == a[0] + 1 else None for a, b in zip(side, side[1:])]
        self.steps = [None, *pairs(left)]  # the tokens of a place and the place just before, if that is shared too
        there = Counter(x for x in pairs(right) if x)
        self.after = [0] * (n + 1)  # pairs of neighbours at most, behind the step to a token
        seen: Counter = Counter()
        for t in range(n - 2, -1, -1):
            self.after[t] = self.after[t + 1]
            step = self.steps[t + 1]
            if step in there:
                seen[step] += 1
                self.after[t] += seen[step] <= there[step]
        self.near = {w for step in seen for w in step}  # tokens that may be in a run of neighbours
        at = dict(right)
        self.able = sum(1 << j for j, w in right if (at.get(j - 1), w) in seen or (w, at.get(j + 1)) in seen)

    def possible(self) -> bool:
        """If a better matching is not ruled out at once; prepares the search."""
        if (self.total - self.after[0], self.base) >= self.best:
            return False
        self._costs()
        self._forced()
        chunks, crossings, _ = self._rest(0, 0, -1, 0)
        return (chunks, self.base + crossings) < self.best

    def _costs(self) -> None:
        """Crossings of a link with the fixed ones; fixed links and earlier occurrences before each step."""
        before, behind = 0, sum(1 << j for j in self.fixed.values())
        self.cost, self.made, self.ended = {}, [0], []
        count = dict.fromkeys(self.free, 0)
        for i, w in self.left:
            self.ended.append(dict(count))
            if i in self.fixed:
                before |= 1 << self.fixed[i]
                behind &= ~(1 << self.fixed[i])
            else:
                count[w] += 1
                for j in self.places[w]:
                    self.cost[i, j] = (before >> (j + 1)).bit_count() + (behind & ((1 << j) - 1)).bit_count()
            self.made.append(self.made[-1] + (i in self.fixed))
        self.ended.append(count)

    def _forced(self) -> None:
        """The k-th link of a token lies between bounds on both sides: which of such links must cross."""
        slots, self.slot = [], {}
        for w in self.free:
            a, b, r = self.own[w], self.places[w], self.need[w]
            if w in self.near and len(a) > len(b):
                continue  # any of its occurrences may be the k-th link's
            self.slot[w] = len(slots)
            for k in range(r):
                slots.append((a[k], a[k + len(a) - r], *((b[0], b[-1]) if w in self.near else (b[k], b[k + len(b) - r]))))
        over = lambda u, v: u[1] < v[0] and u[2] > v[3]
        self.cross = [sum(1 << k for k, v in enumerate(slots[:m]) if over(u, v) or over(v, u)) for m, u in enumerate(slots)]
        self.known: dict[int, int] = {}

    def _crossing(self, slots: int) -> int:
        if slots not in self.known:
            self.known[slots] = sum((x & slots).bit_count() for u, x in enumerate(self.cross) if slots >> u & 1)
        return self.known[slots]

    def _open(self, w, used: int, runs: int) -> list[int]:
        """Places of a token that a link may still go to; `runs` has those of links in a run of neighbours."""
        mine = used & self.mask[w]
        if w not in self.near:  # in order
            top = mine.bit_length()
            return [j for j in self.places[w] if j >= top]
        top = (mine & ~runs).bit_length()
        return [j for j in self.places[w] if not used >> j & 1 and (j >= top or self.able >> j & 1)]

    def _rest(self, t: int, used: int, last: int, runs: int):
        """(chunks and crossings that the rest costs at least, what the rest depends on), None for the latter if there
        is no way on."""
        key, crossings, slots = [], 0, 0
        for w in self.free:
            r = self.need[w] - (used & self.mask[w]).bit_count()
            if not r:
                continue
            if w in self.slot:
                slots |= ((1 << r) - 1) << (self.slot[w] + self.need[w] - r)
            ahead, to, in_order = self.own[w][self.ended[t][w] :], self._open(w, used, runs), w not in self.near
            if len(to) < r:
                return 0, 0, None
            beyond = [(used >> (j + 1)).bit_count() for j in to]
            key += [w, tuple(to), tuple(beyond)]
            cost = self.cost
            if r == len(ahead):  # each of them gets a link
                m = len(to) - r
                for k, i in enumerate(ahead):
                    lo, hi = (k, k + m + 1) if in_order else (0, len(to))
                    crossings += min(cost[i, to[q]] + beyond[q] for q in range(lo, hi))
            else:  # each free place gets one
                m = len(ahead) - r
                for k, (j, b) in enumerate(zip(to, beyond)):
                    crossings += b + min(cost[i, j] for i in (ahead[k : k + m + 1] if in_order else ahead))
        crossings += self._crossing(slots)
        joins = 0
        if t < len(self.left) and last >= 0 and self.steps[t] is not None:
            i, w = self.left[t]
            joins = self.fixed[i] == last + 1 if i in self.fixed else self.mask[w] >> (last + 1) & 1 and not used >> (last + 1) & 1
        chunks = self.total - used.bit_count() - self.made[t] - joins - self.after[t]
        return chunks, crossings, (last if joins else -1, *key)

    def run(self, wide: int, all_states: bool) -> None:
        """A state: chunks, crossings, places in use (without fixed ones), place of the link of the token just before or
        -1, places of links in runs, if that last link has to begin a run, links."""
        stack = [(0, [(0, self.base, 0, -1, 0, False, None)])]
        while stack:
            t, states = stack.pop()
            while t < len(self.left) and states:
                found: dict = {}
                for state in states:
                    self._step(t, state, found)
                t += 1
                kept = sorted(found.values(), key=lambda x: x[0])
                if all_states and len(kept) > wide:
                    stack.append((t, [x for bound, x in kept[wide:]]))
                states = [x for bound, x in kept[:wide] if bound < self.best]
            for chunks, crossings, *_, links in states:
                if (chunks, crossings) < self.best:
                    self.best, self.links = (chunks, crossings), []
                    while links:
                        links, i, j = links
                        self.links.append((i, j))
                    self.links.reverse()

    def _step(self, t: int, state: tuple, found: dict) -> None:
        chunks, crossings, used, last, runs, begin, links = state
        i, w = self.left[t]
        if self.steps[t] is None:
            last = -1
        follow = self.mask[self.left[t + 1][1]] if t + 1 < len(self.left) and self.steps[t + 1] is not None else 0

        def put(chunks, crossings, used, last, runs, begin, links):
            more, over, key = self._rest(t + 1, used, last, runs | (1 << last if follow and last >= 0 else 0))
            bound = (chunks + more, crossings + over)
            if key is None or bound >= self.best or begin and key[0] < 0:
                return
            old = found.get(key)
            if old is None or (chunks, crossings, begin) < (old[1][0], old[1][1], old[1][5]):
                found[key] = bound, (chunks, crossings, used, last, runs, begin, links)

        def link(j, used, cost, own):
            joins = last >= 0 and j == last + 1
            if begin and not joins:
                return
            start = False
            if not joins and (own >> (j + 1) << (j + 1)) & ~runs:  # crosses a link of its token outside every run
                if not follow >> (j + 1) & 1:
                    return
                start = True
            put(chunks + (not joins), crossings + cost, used, j, runs | (1 << last | 1 << j if joins else 0), start, (links, i, j))

        if i in self.fixed:
            return link(self.fixed[i], used, 0, 0)
        mine = used & self.mask[w]
        r = self.need[w] - mine.bit_count()
        if r:
            to = self._open(w, used, runs)
            for j in to if w in self.near else to[: len(to) - r + 1]:
                link(j, used | 1 << j, self.cost[i, j] + (used >> (j + 1)).bit_count(), mine)
        if r < len(self.own[w]) - self.ended[t][w] and not begin:  # it may go without: enough others follow
            put(chunks, crossings, used, -1, runs, False, links)
