"""Small plain models the Spark operators are compared with."""

from collections import Counter


def greedy_bpe(counts: dict[str, int], vocab_size: int, specials=("[UNK]", "[PAD]", "[EOS]")):
    """One merge at a time: most frequent pair, ties by smaller ids."""
    tokens = [*specials, *sorted({c for w in counts for c in w})]
    ids = {t: i for i, t in enumerate(tokens)}
    words = {w: [ids[c] for c in w] for w in counts}
    merges = []
    while len(tokens) < vocab_size:
        pairs = Counter()
        for w, symbols in words.items():
            for pair in zip(symbols, symbols[1:]):
                pairs[pair] += counts[w]
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        text = tokens[best[0]] + tokens[best[1]]
        if text not in ids:
            ids[text] = len(tokens)
            tokens.append(text)
        merges.append((*best, ids[text]))
        for w, symbols in words.items():
            out = []
            for s in symbols:
                # leftmost first: a pair closes as soon as its second symbol arrives
                if out and (out[-1], s) == best and not (out[-1] == ids[text]):
                    out[-1] = ids[text]
                else:
                    out.append(s)
            words[w] = out
    return tokens, merges


def checkpoint_chain(rows, limits):
    """rows of (seq, epoch, step, seconds), in order."""
    last, fired = (0, 0, rows[0][3]), []
    for seq, *now in rows:
        if any(a - b >= limit for a, b, limit in zip(now, last, limits)):
            fired.append(seq)
            last = tuple(now)
    return fired
