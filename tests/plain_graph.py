"""Plain Python versions of the partitioner, coarsening, placement and layout: loops over dictionaries, no shared code but force constants."""

import hashlib
import math
from collections import Counter, defaultdict

TINY = 1e-5


def draw(key, salt, seed=42):
    return int(hashlib.md5(f"{key}:{salt}:{seed}".encode()).hexdigest()[:8], 16) / 4294967296.0


def half_up(x, digits):
    """Rounded as SQL does: a half goes away from zero, as written in decimal."""
    from decimal import ROUND_HALF_UP, Decimal

    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def neighbours(edges):
    near = defaultdict(dict)
    for (a, b), w in edges.items():
        near[a][b] = w
    return near


# --- partitioner -------------------------------------------------------------------------------


def partition_rounds(ids, edges, k, rounds, capacity=0.1, seed=42):
    """Labels after each round, from the first labels on."""
    near = neighbours(edges)
    part = {v: int(draw(v, 501, seed) * k) for v in ids}
    room = round(len(edges) * (1 + capacity) / k)
    out = [dict(part)]
    for r in range(rounds):
        load = Counter()
        for v in near:
            load[part[v]] += len(near[v])
        least = min(range(k), key=lambda p: (load[p], p))
        wish = {}
        for v in near:
            heard, total = Counter(), sum(near[v].values())
            for u, w in near[v].items():
                heard[part[u]] += w
            h = {p: 1.0 + heard[p] / total - math.ceil(half_up(load[p] / room * 1000, 6)) / 1000.0 for p in {*heard, part[v], least}}
            wish[v] = max(h, key=lambda p: (half_up(h[p], 9), p == part[v], draw(f"{v}-{p}", 600 + r, seed), p))
        demand = Counter()
        for v, p in wish.items():
            if p != part[v]:
                demand[p] += len(near[v])
        for v, p in wish.items():
            if p != part[v] and draw(v, 900 + r, seed) < max(0.0, (room - load[p]) / demand[p]):
                part[v] = p
        out.append(dict(part))
    return out


# --- coarsening --------------------------------------------------------------------------------


def systems(weight, edges, layer, chance, seed=42):
    """Bodies id: (sun, hops, weight from the sun, proxy), and for each moon its ways: proxy: weight."""
    near, left, bodies, proxies, number = neighbours(edges), set(weight), {}, defaultdict(dict), -1
    while left:
        number += 1
        rank = {v: (weight[v] + 1, -v) for v in left if draw(v, layer * 1000 + number, seed) < min(1.0, chance)}
        chance *= 1.05
        suns = {v for v in rank if not any(u in rank and rank[u] < rank[v] for m in near[v] for u in [m, *(near[m] if m in left else [])] if u != v)}
        free = left - suns
        new = {s: (s, 0, 0, s) for s in suns}
        for v in free:
            if offers := [(near[v][s], s) for s in near[v] if s in suns]:
                w, s = min(offers)
                new[v] = (s, 1, w, s)
        for v in free - set(new):
            ways = [(new[p][2] + near[v][p], new[p][0], p) for p in near[v] if p in new and new[p][1] == 1]
            if ways:
                w, s, p = min(ways)
                proxies[v] = {q: x for x, t, q in ways if t == s}
                new[v] = (s, 2, w, p)
        bodies |= new
        left -= set(new)
    return bodies, proxies


def coarsen(component, edges, threshold=7, chance=0.1, seed=42):
    """Layers from finest to coarsest: component, weight, edges and, below the top, bodies, proxies and paths."""
    layers = [{"component": component, "weight": {v: 1 for v in component}, "edges": edges}]
    while True:
        here = layers[-1]
        if len(layers) > 1 and (max(Counter(here["component"].values()).values(), default=0) <= threshold or len(here["component"]) == len(layers[-2]["component"])):
            return layers
        bodies, proxies = systems(here["weight"], here["edges"], len(layers) - 1, chance, seed)
        up, paths = {}, set()
        for (a, b), w in here["edges"].items():
            s, t = bodies[a][0], bodies[b][0]
            if s == t:
                continue
            for proxy, via in [(None, bodies[a][2])] if bodies[a][1] < 2 else proxies[a].items():
                for key in ((s, t), (t, s)):
                    up[key] = max(up.get(key, 0), via + w + bodies[b][2])
                if a != s:
                    paths.add((s, a, t, via))
                if proxy is not None:
                    paths.add((s, proxy, t, bodies[proxy][2]))
        here |= {"bodies": bodies, "proxies": proxies, "paths": paths}
        weight = Counter()
        for v, (s, *_) in bodies.items():
            weight[s] += here["weight"][v] + 1
        layers.append({"component": {s: here["component"][s] for s in weight}, "weight": dict(weight), "edges": up})


def place(layer, number, places, upper_edges, ideal, seed=42):
    along = defaultdict(list)
    for s, body, t, position in layer["paths"]:
        share = position / upper_edges[(s, t)]
        along[body].append(((places[t][0] - places[s][0]) * share, (places[t][1] - places[s][1]) * share))
    out = {}
    for v, (s, hops, w, _) in layer["bodies"].items():
        x, y = places[s]
        angle = draw(v, 301 + number, seed) * 2 * math.pi
        if hops == 0:
            out[v] = (x, y)
        elif v in along:
            shift = draw(v, 201 + number, seed) * 2 - 1
            out[v] = tuple(c + sum(a[i] for a in along[v]) / len(along[v]) + shift for i, c in enumerate((x, y)))
        elif hops == 1:
            out[v] = (x + math.cos(angle) * w * ideal, y + math.sin(angle) * w * ideal)
    for v, (_, _, w, p) in layer["bodies"].items():
        if v not in out:
            angle, step = draw(v, 301 + number, seed) * 2 * math.pi, (w - layer["bodies"][p][2]) * ideal
            out[v] = (out[p][0] + math.cos(angle) * step, out[p][1] + math.sin(angle) * step)
    return out


# --- layout ------------------------------------------------------------------------------------


def balls(near, k):
    out = {}
    for v in near:
        seen, edge = {v}, {v}
        for _ in range(k):
            edge = {u for w in edge for u in near[w]} - seen
            seen |= edge
        out[v] = seen - {v}
    return out


def fuzzy(x):
    return x or TINY


def layout(places, component, edges, ideal, k, temp_factor, cooling, accuracy, limit, max_weight=1, convergence=0.85, rescale=True, size=None):
    """Places after the moves, and how many there were. Attraction and repulsion as Fruchterman and Reingold have them."""
    near = neighbours(edges)
    ball, heat = balls(near, k), {}
    members = defaultdict(list)
    for v, c in component.items():
        members[c].append(v)
    p = dict(places)
    for c, vs in members.items():
        n, edge = sum((size or {}).get(v, 1) for v in vs), max_weight * ideal
        x0, y0 = min(places[v][0] for v in vs), min(places[v][1] for v in vs)
        w = fuzzy(max(places[v][0] for v in vs) - x0) + edge
        h = fuzzy(max(places[v][1] for v in vs) - y0) + edge
        fw = 1.0 if n == 1 else math.sqrt(n / (h / w)) * edge
        fh = 1.0 if n == 1 else h / w * fw
        heat[c] = (0.0, 0.0) if n == 1 else (fw / temp_factor, fh / temp_factor)
        if rescale:
            for v in vs:
                p[v] = ((places[v][0] - x0) * (1.0 if n == 1 else fw / w), (places[v][1] - y0) * (1.0 if n == 1 else fh / h))
    strength, t = 2.0 * edge_square(max_weight * ideal), 1.0
    for step in range(1, limit + 1):
        new, still = {}, 0
        for v, c in component.items():
            fx = fy = 0.0
            for u, w in near[v].items() if v in near else ():
                dx, dy = p[u][0] - p[v][0], p[u][1] - p[v][1]
                pull = math.sqrt(fuzzy(dx * dx + dy * dy)) / (w * ideal)
                fx, fy = fx + dx * pull, fy + dy * pull
            for u in ball.get(v, ()):
                dx, dy = p[u][0] - p[v][0], p[u][1] - p[v][1]
                push = strength / fuzzy(dx * dx + dy * dy)
                fx, fy = fx - dx * push, fy - dy * push
            f = fuzzy(math.hypot(fx, fy))
            mx, my = fx / f * min(f, heat[c][0] * t), fy / f * min(f, heat[c][1] * t)
            new[v] = (p[v][0] + mx, p[v][1] + my)
            still += fuzzy(math.hypot(mx, my)) < accuracy
        p = new
        if step > 5 and still >= convergence * len(component):
            return p, step
        t *= cooling
    return p, limit


def edge_square(x):
    return x**2
