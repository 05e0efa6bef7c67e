"""The operators' kernels, without Spark: exact round trips and brute-force versions."""

import base64
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenq.llm import bitpack, bpe, imatch, jaccard, langid, packing, pii, sharding, textvec, warc, webp

TEXTS = ["", " ", "a", "  two  spaces ", "it's don't 'r e\n\n x", "é à  b　c d", "日本 語\ttab", "x" * 3000, "line\n" * 50, "Ünï ÇØDE 123,456.7 !!"]


def terms(t):
    return re.findall(textvec.TERM_PATTERN, t.lower())


@pytest.mark.parametrize("n", [1, 2, 3])
def test_grams_equal_brute_force(n):
    got = list(textvec.row_grams(pa.array([*TEXTS, None]), n))
    for t, g in zip([*TEXTS, ""], got, strict=True):
        w = terms(t)
        assert len(g) == len({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    assert (list(textvec.row_grams(pa.array(["b a b a"]), n))[0] == list(textvec.row_grams(pa.array(["x", "B, a; b a"])[1:], n))[0]).all()


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder.of(bpe.VOCABULARY)


def test_batch_encoding_is_exact(coder):
    o, ids = coder.batch(pa.array([*TEXTS, None]))
    for i, t in enumerate([*TEXTS, ""]):
        assert ids[o[i] : o[i + 1]].tolist() == coder.one(t)
        assert coder.decode(ids[o[i] : o[i + 1]]).decode() == t


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab 'sé\n\t.1 ", max_size=400), st.integers(0, 5))
def test_joins_are_repaired(t, seed):
    c = bpe.Coder.of(bpe.VOCABULARY)
    raw, r = t.encode(), random.Random(seed)
    cuts = sorted({len(t[:k].encode()) for k in (r.randint(0, len(t)) for _ in range(4))} | {0, len(raw)})
    known = [(s, e, bpe._encode_bytes(c, raw[s:e])) for s, e in zip(cuts, cuts[1:], strict=False) if e > s and r.random() < 0.7]
    assert bpe.assemble(c, raw, known).tolist() == c.one(t)


def test_chunks_depend_on_content_only():
    r = random.Random(1)
    body = " ".join("".join(r.choices("abcdeé", k=r.randint(1, 9))) for _ in range(4000)).encode()
    a = {h for *_, h in bpe.chunks_of(np.frombuffer(body, np.uint8))}
    b = {h for *_, h in bpe.chunks_of(np.frombuffer(b"a new beginning " + body, np.uint8))}
    assert len(a & b) >= len(a) - 2 and len(a) > 5


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31])
def test_bits_round_trip_and_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000)
    raw, offs = bitpack.pack(ids, bits, block=64)
    assert len(offs) == 17 and offs[-1] == len(raw)
    assert (bitpack.read(raw, offs, bits, 1000, block=64) == ids).all()
    assert (bitpack.read(raw, offs, bits, 1000, 130, 700, block=64) == ids[130:700]).all()
    with pytest.raises(ValueError):
        bitpack.pack(np.array([1 << bits]), bits)


def test_width():
    assert [bitpack.width(n) for n in (1, 2, 3, 256, 257, 50257)] == [1, 1, 2, 8, 9, 16]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_each_bin_is_the_fullest_that_holds_the_longest(lengths):
    left = list(range(len(lengths)))
    for b in packing.pack_lengths(lengths, 12):
        assert max(lengths[i] for i in left) == max(lengths[i] for i in b)
        rest = list(left)
        rest.remove(next(i for i in left if lengths[i] == max(lengths[j] for j in left)))
        top = max(lengths[i] for i in left)
        best = max(top + sum(lengths[i] for i in c) for k in range(len(rest) + 1) for c in itertools.combinations(rest, k) if top + sum(lengths[i] for i in c) <= 12)
        assert sum(lengths[i] for i in b) == best
        left = [i for i in left if i not in b]
    assert not left


def test_flow_moves_the_fewest_bytes():
    for seed in range(40):
        r = random.Random(seed)
        old, new = {f"s{i}": r.randint(0, 6) for i in range(3)}, {f"s{i}": r.randint(0, 8) for i in range(4)}
        if sum(old.values()) > sum(new.values()):
            with pytest.raises(ValueError):
                sharding.min_cost_flow(old, new)
            continue
        costs = {(a, b): r.randint(0, 5) for a in old for b in new}
        flow = sharding.min_cost_flow(old, new, lambda a, b: costs[a, b])
        assert all(sum(x for (p, _), x in flow.items() if p == a) == old[a] for a in old) and all(sum(x for (_, q), x in flow.items() if q == b) <= new[b] for b in new)
        units = [a for a in old for _ in range(old[a])]
        best: dict = {tuple(new.values()): 0}
        for a in units:  # every unit in turn, to every shard with room
            step: dict = {}
            for room, c in best.items():
                for j, b in enumerate(new):
                    if room[j]:
                        key = room[:j] + (room[j] - 1,) + room[j + 1 :]
                        step[key] = min(step.get(key, 1 << 30), c + costs[a, b])
            best = step
        assert sum(costs[k] * x for k, x in flow.items()) == min(best.values())


def test_webp_round_trips():
    r = np.random.default_rng(3)
    for k in range(28):
        h, w = (int(x) for x in r.integers(1, 22, 2))
        if k % 3 == 1:
            im = r.integers(0, (1, 3, 10, 40)[k % 4] + 1, (h, w)).astype(np.uint32) * np.uint32(0x01020304)
        else:
            im = r.integers(0, 1 << 32, (h, w), dtype=np.uint64).astype(np.uint32)
            im[h // 2 :] = im[: h - h // 2]
        raw = webp.encode(im, predictor=[None, k % 14, list(range(14))][k % 3], cross=[None, (5, -9, 17)][k % 2], green=bool(k & 2), palette=k % 3 == 1, cache_bits=(0, 1, 6, 11)[k % 4], lz77=bool(k & 1), tile=(None, 2, 3)[k % 3])
        assert (webp.decode(raw) == im).all()
    for bad in (b"", b"RIFF", raw[: len(raw) // 2], b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 20):
        with pytest.raises(ValueError):
            webp.decode(bad)
    assert len(set(webp._NEAR)) == 120


KEY = b"key of the tests"


def test_pseudonyms():
    values = [("email", "jane.doe7@mail.example.org"), ("ip", "10.2.3.4"), ("iso", "2024-02-29"), ("day", "31/12/1999"), ("day", "1.2.2020"), ("ssn", "123-45-6789"), ("phone", "+1 (743) 555-3824"), ("card", "4111 1111 1111 1111"), ("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "at611904300234573201"), ("secret", "0a" * 20), ("bare", "abcdefghijklmno1")]
    for kind, v in values:
        p = pii.pseudonym(kind, v, KEY)
        assert p != v and pii.pseudonym(kind, p, KEY, by=-1) == v and pii.pseudonym(kind, v, KEY) == p
        assert [c.isdigit() for c in p if not c.isalnum()] == [c.isdigit() for c in v if not c.isalnum()]
        assert pii.pseudonym(kind, v, b"another key") != p
    p = pii.pseudonym("card", "4111111111111111", KEY)
    assert pii.luhn_ok(p) and pii.issued(p)
    for kind, v in [("card", "4111111111111112"), ("ip", "300.1.1.1"), ("iso", "2023-02-29"), ("ssn", "000-12-3456"), ("iban", "DE00 3704 0044 0532 0130 00"), ("iban", "AT61 1904 3002 3457 3201 00"), ("bare", "internationalisations")]:
        assert pii.pseudonym(kind, v, KEY) is None
    clean = "Version 2.0 of CC BY-NC 4.0, in 1999, page 12-14; é@ 4111111111111112; password: internationalisations"
    assert pii.rewrite(clean, KEY) == (clean, 0)
    text = "a jane.doe7@mail.example.org, again jane.doe7@mail.example.org; 152.143.123.131!! token = \"" + "0a" * 20 + '"'
    new, n = pii.rewrite(text, KEY)
    assert n == 4 and "jane" not in new and "152.143" not in new and "0a0a" not in new and pii.reveal(new, KEY) == text
    small = pii.Permutation(10, "t", b"k")
    assert sorted(small.step(x) for x in range(10)) == list(range(10)) and all(small.step(x) != x for x in range(10))


def windows(text):
    """Every stretch of digits and single separators of 13 to 19 digits, by brute force."""
    out = set()
    for s in range(len(text)):
        if text[s].isdigit() and not (s and text[s - 1].isdigit()):
            for e in range(s + 13, min(len(text), s + 40) + 1):
                v = text[s:e]
                if re.fullmatch("[0-9](?:[ -]?[0-9])*", v) and not text[e : e + 1].isdigit():
                    digits = re.sub("[^0-9]", "", v)
                    if 13 <= len(digits) <= 19:
                        out.add(digits)
    return out


def test_no_planted_value_stays_in_clear():
    """Valid values of each kind beside digits, dates, codes and words: none is left, whatever stands around it."""
    values = ["4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "3782 822463 10005", "6011000990139424", "jane.doe7@mail.example.org", "10.2.3.4", "2024-02-29", "31/12/1999", "123-45-6789", "+1 (743) 555-3824", "743-555-3824", "DE89 3704 0044 0532 0130 00", "at611904300234573201", "GB29 NWBK 6016 1331 9268 19"]
    around = ["", "12", "order 12", "2024-01-05", "12/26", "123 cvv", "was", "07", "5 of 9", "x", "4242 4242 4242 4242", "tel", "no. 3,"]
    for v in values:
        for a, b in itertools.product(around, around):
            text = f"{a} {v} {b}".strip()
            new, n = pii.rewrite(text, KEY)
            assert n and v not in new and (len(new) == len(text) or v == "10.2.3.4"), (text, new)
            digits = re.sub("[^0-9]", "", v)
            if pii.luhn_ok(digits):
                assert digits not in windows(new), (text, new)
    assert pii.rewrite('password=Abcdefgh12345678, secret:\n"aaaaaaaaaaaaaaaa"', KEY)[1] == 2


def test_odd_digits():
    digits = "1234567890" * 20_000
    assert pii.rewrite(digits, KEY) == (digits, 0)
    spaced = " ".join("12345678901" * 1000)
    new, _ = pii.rewrite(spaced, KEY)
    assert len(new) == len(spaced) and not any(pii.luhn_ok(x) and pii.issued(x) for x in windows(spaced) & windows(new))
    cards = "4111 1111 1111 1111 " * 2000
    new, n = pii.rewrite(cards, KEY)
    assert n == 2000 and len(set(new.split(" "))) <= 5 and pii.reveal(new, KEY) == cards



def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 20):
        m = langid.codewords(n)
        assert len({tuple(r) for r in m.tolist()}) == n and (np.abs(m.sum(0)) < n).all()


def test_language_of_held_out_texts():
    r = random.Random(0)
    vocab = {"en": "the of and thing other".split(), "de": "der und nicht schön heit".split(), "fr": "le été que aux eau".split()}
    make = lambda lang: " ".join(r.choice(vocab[lang]) for _ in range(30))
    labels = [x for x in vocab for _ in range(30)]
    model = langid.train([make(x) for x in labels], labels)
    held = [x for x in vocab for _ in range(20)]
    lang, margin, unsure = model.decide(pa.array([make(x) for x in held]))
    assert lang == held and not unsure.any() and (margin > 0.2).all()
    lang, _, unsure = model.decide(pa.array(["", None, "123 !!", " ".join(v for w in vocab.values() for v in w)]))
    assert lang[:3] == ["und"] * 3 and unsure[:3].all()
    assert langid.train([], []).decide(pa.array(["x"]))[0] == ["und"]
    assert langid.train(["some text"], ["en"]).decide(pa.array(["more"]))[0] == ["en"]


def test_similar_equals_brute_force():
    r = random.Random(2)
    sets = [np.array(sorted(r.sample(range(60), r.randint(0, 30))), np.uint64) for _ in range(40)]
    got = {(a, b): j for a, b, j in jaccard.similar(sets, list(range(40)), list(range(40)), lambda q, m: m < q, 0.3)}
    for a in range(40):
        for b in range(a):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            j = len(x & y) / len(x | y) if x | y else 0.0
            assert (j >= 0.3) == ((a, b) in got) and (j < 0.3 or abs(got[a, b] - j) < 1e-12)


def test_counted_links_equal_brute_force():
    r = random.Random(3)
    sets = [np.array(sorted(r.sample(range(60), r.randint(0, 30))), np.uint64) for _ in range(40)]
    numbers, inside = np.array(r.sample(range(1000), 40)), np.array([k % 3 > 0 for k in range(40)])
    weights, odd = np.array([r.randrange(5) for _ in range(40)]), np.array([k % 7 == 0 for k in range(40)])
    members = [k for k in range(40) if inside[k]]
    links, edges, apart = jaccard.count_links(sets, list(range(40)), members, numbers, inside, weights, odd, 0.25)
    found = [(q, m) for q, m, _ in jaccard.similar(sets, list(range(40)), members, lambda q, m: numbers[m] < numbers[q] if inside[q] else True, 0.25)]
    want = np.zeros(40, np.int64)
    for q, m in found:
        want[q] += weights[m]
        want[m] += weights[q]
    assert len(found) > 40 and (links == want).all()
    assert sorted(map(tuple, apart.tolist())) == sorted((q, m) for q, m in found if odd[q] or odd[m])

    def parts(pairs):
        root = list(range(40))
        for _ in root:
            for x, y in pairs:
                root[x] = root[y] = min(root[x], root[y])
        return root

    assert {tuple(x) for x in edges.tolist()} <= set(found) and parts(edges.tolist()) == parts(found) and len(edges) == 40 - len(set(parts(found)))


def test_prefixes_of_similar_sets_meet():
    r = np.random.default_rng(5)
    order = r.integers(0, 256, 1 << jaccard.SKETCH_BITS).astype(np.uint8)

    def keys(x):
        cuts = jaccard.cuts_of(x, 0.65)
        return jaccard.prefix_keys(x[: cuts[0]], cuts, len(x), order, 0.65)

    missed = total = 0
    for size in (2, 5, 20, 100, 400, 2000):
        for _ in range(60):
            base = r.integers(0, 1 << 64, size * 2, dtype=np.uint64)
            x, cut = np.unique(base[:size]), int(r.integers(0, max(1, size // 5)))
            y = np.unique(np.concatenate([base[cut:size], base[size : size + cut]]))
            j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            if 0.65 <= j < 1:
                total += 1
                missed += len(np.intersect1d(keys(x), keys(y))) < min(jaccard.matches(len(x), 0.65), jaccard.matches(len(y), 0.65))
    assert total > 100 and missed <= 0.02 * total


def test_warc_records():
    ident, digest, raw = warc.response(7, "http://a.example/x y", "<p>é</p>")
    assert warc.response(7, "http://a.example/x y", "<p>é</p>") == (ident, digest, raw)
    (at, size, head, block), = warc.records(warc.member(raw))
    assert at == 0 and size == len(warc.member(raw)) and head["WARC-Target-URI"] == "http://a.example/x%20y" and block.endswith("<p>é</p>".encode())
    assert head["WARC-Payload-Digest"] == digest and head["WARC-Block-Digest"] == warc._digest(block)
    assert warc.response(None, None, None)[1] == warc._digest(b"")


def test_fingerprint_of_no_terms():
    assert imatch.fingerprint([], {}) == [None] * (imatch.SUBSETS + 1)
    assert imatch.fingerprint([b"a", b"b"], {}) == imatch.fingerprint([b"a", b"b"], {})


def test_sketch_blocks():
    r = np.random.default_rng(3)
    parts = [np.minimum(r.zipf(1.3, 5000), (1 << jaccard.SKETCH_BITS) - 1).astype(np.uint32) * np.uint32(997) % np.uint32(1 << jaccard.SKETCH_BITS) for _ in range(3)]
    want = np.bincount(np.concatenate(parts), minlength=1 << jaccard.SKETCH_BITS)
    by = {}
    for p in parts:
        for k, raw in jaccard._sparse_blocks(p):
            by.setdefault(k, []).append(raw)
    for k in range(1 << (jaccard.SKETCH_BITS - jaccard.BLOCK_BITS)):
        own = want[k << jaccard.BLOCK_BITS : (k + 1) << jaccard.BLOCK_BITS]
        assert (jaccard._dense_block(by.get(k, [])) == np.minimum(255, np.round(6 * np.log2(own + 1)))).all()


def made_up(lang, r, n):
    """Words of one of four invented languages, which share letters but prefer other syllables."""
    syllables = {"a": "ka lo mi ter an so ri de".split(), "b": "sch ung ein ver ter an keit lo".split(), "c": "eau oui tion re de mi ette an".split(), "d": "ção os ndo ra de lo ter que".split()}[lang]
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_ambiguous_texts_are_flagged():
    """Of held-out texts at least 0.98 are accepted and right; of splices of two languages and of other scripts at least 0.8 are flagged."""
    r = random.Random(8)
    rows = [(made_up(x, r, r.randint(20, 400)), x) for x in "abcd" for _ in range(400)]
    model = langid.train(*zip(*rows, strict=True))
    clean = [(made_up(x, r, r.randint(20, 400)), x) for x in "abcd" for _ in range(100)]
    lang, _, unsure = model.decide(pa.array([t for t, _ in clean]))
    assert sum(a == b and not u for a, (_, b), u in zip(lang, clean, unsure, strict=True)) >= 0.98 * len(clean)
    mixed = [made_up(x, r, r.randint(60, 400)) + " " + made_up(y, r, r.randint(60, 400)) for x, y in itertools.permutations("abcd", 2) for _ in range(20)]
    assert model.decide(pa.array(mixed))[2].mean() >= 0.8
    other = ["Это предложение на русском языке", "ελληνικό κείμενο για δοκιμή", "日本語の文章です。これは試験です", "한국어 문장입니다"]
    assert model.decide(pa.array(other))[2].all()


def test_windows_add_up_to_rows():
    r = random.Random(9)
    rows = [(made_up(x, r, 50), x) for x in "abcd" for _ in range(20)]
    model = langid.train(*zip(*rows, strict=True))
    long = made_up("a", r, 200_000)
    texts = pa.array(["", None, long, "12 34", made_up("b", r, 3), long])
    f, letters, parts, part_letters, part_rows = model.margins(texts)
    for i in range(len(texts)):
        assert part_letters[part_rows == i].sum() == letters[i]
        if letters[i]:
            assert np.allclose((parts * part_letters[:, None])[part_rows == i].sum(0) / letters[i], f[i], atol=1e-3)
    lang, _, unsure = model.decide(texts)
    assert lang[:2] == ["und", "und"] and lang[2] == lang[5] == "a" and not unsure[2] and unsure[[0, 1, 3]].all()


def test_three_languages_tie_goes_to_the_first():
    model = langid.train(["x", "x", "x"], ["c", "a", "b"])
    lang, margin, unsure = model.decide(pa.array(["x", "y"]))
    assert lang == ["a", "a"] and (margin == 0).all()


def test_flow_of_a_thousand_shards():
    """In seconds, every byte placed, no more moved than what shards can't keep."""
    r = random.Random(12)
    old = {f"s{k:04d}": r.randint(1, 1 << 40) for k in range(1000)}
    room = sharding.layout(sum(old.values()), sorted(old))
    flow = sharding.min_cost_flow(old, room)
    for a, n in old.items():
        assert sum(x for (i, _), x in flow.items() if i == a) == n
    assert all(sum(x for (_, j), x in flow.items() if j == b) <= room[b] for b in room)
    assert sum(x for (a, b), x in flow.items() if a != b) == sum(max(0, n - room[a]) for a, n in old.items())


def webp_of(*fields):
    """A file around a lossless stream that is written out field by field, (value, bits), from the format's specification."""
    hold = n = 0
    for value, bits in fields:
        hold |= value << n
        n += bits
    body = hold.to_bytes((n + 7) // 8, "little")
    body += b"\0" * (len(body) & 1)
    return b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body


def one(symbol):
    """A simple code of one 8-bit symbol, which takes no bits to read."""
    return [(1, 1), (0, 1), (1, 1), (symbol, 8)]


def two(a, b):
    return [(1, 1), (1, 1), (1, 1), (a, 8), (b, 8)]


def head(w, h):
    return [(0x2F, 8), (w - 1, 14), (h - 1, 14), (1, 1), (0, 3)]


FLAT = [(0, 1), (0, 1)]  # no colour cache, no groups


def plain(green, red, blue, alpha, distance=0):
    return [*one(green), *one(red), *one(blue), *one(alpha), *one(distance)]


def test_streams_of_no_encoder():
    """Streams written out by hand, and one of another encoder, with the pixels that the specification gives."""
    none = [(0, 1)]
    assert (webp.decode(webp_of(*head(2, 1), *none, *FLAT, *plain(0x12, 0x34, 0x56, 0xFF))) == 0xFF341256).all()
    # subtract green
    assert webp.decode(webp_of(*head(1, 1), (1, 1), (2, 2), *none, *FLAT, *plain(0x10, 0x01, 0xF2, 0xFF))).tolist() == [[0xFF111002]]
    # a palette of two colours as differences, eight indices in a pixel: 1, 0, 1
    table = [(0, 1), *two(0, 20), *two(0, 10), *two(0, 30), *two(255, 0), *one(0), (0, 1), (0, 1), (0, 1), (0, 1), (1, 1), (1, 1), (1, 1), (1, 1)]
    assert webp.decode(webp_of(*head(3, 1), (1, 1), (3, 2), (1, 8), *table, *none, *FLAT, *plain(5, 0, 0, 255))).tolist() == [[0xFF0A141E, 0xFF000000, 0xFF0A141E]]
    # predictor: black, left, top, then mode 5 of left, top right (this row's first) and top
    modes = [(0, 3), (0, 1), *plain(5, 0, 0, 255)]
    assert webp.decode(webp_of(*head(2, 2), (1, 1), (0, 2), *modes, *none, *FLAT, *plain(2, 1, 3, 0))).tolist() == [[0xFF010203, 0xFF020406], [0xFF020406, 0xFF030609]]
    # cross-colour: green to red 32/32, green to blue -32/32, red to blue 32/32: red 5 + 4, blue 7 - 4 + 9
    element = [(0, 3), (0, 1), *plain(0xE0, 0x20, 0x20, 255)]
    assert webp.decode(webp_of(*head(1, 1), (1, 1), (1, 2), *element, *none, *FLAT, *plain(4, 5, 7, 255))).tolist() == [[0xFF09040C]]
    # a normal code of two symbols (literal 17 and length 3), then a copy from one pixel back
    lengths = [(0, 1), (0, 4), (0, 3), (1, 3), (0, 3), (1, 3), (0, 1), (1, 1), (6, 7), (0, 1), (1, 1), (127, 7), (1, 1), (91, 7), (0, 1), (1, 1), (10, 7)]
    assert webp.decode(webp_of(*head(4, 1), *none, *FLAT, *lengths, *one(1), *one(2), *one(255), *one(1), (0, 1), (1, 1))).tolist() == [[0xFF011102] * 4]
    # Google's 1 x 1 picture for feature tests
    got = webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert got.shape == (1, 1)


def test_large_and_hostile_images():
    bomb = webp_of(*head(16384, 16384), (0, 1), *FLAT, *plain(1, 2, 3, 4))
    with pytest.raises(ValueError, match="pixels"):
        webp.decode(bomb)
    flat = webp.decode(webp_of(*head(2048, 2048), (0, 1), *FLAT, *plain(1, 2, 3, 4)))
    assert flat.shape == (2048, 2048) and (flat == 0x04020103).all()
    r = np.random.default_rng(4)
    im = r.integers(0, 1 << 32, (70, 200), dtype=np.uint64).astype(np.uint32)
    for mode in range(14):
        raw = webp.encode(im, predictor=mode, sub_tile=6)
        assert (webp.decode(raw) == im).all()
        for cut in (len(raw) // 3, len(raw) - 40):
            with pytest.raises(ValueError):
                webp.decode(raw[:cut])
            short = raw[:16] + (cut - 20).to_bytes(4, "little") + raw[20:cut]
            with pytest.raises(ValueError):
                webp.decode(short)
