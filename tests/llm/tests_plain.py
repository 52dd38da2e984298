"""Plain versions of operators for tests."""

from __future__ import annotations

import hashlib
from collections import Counter

from loomlog.llm.alignment import byte_alphabet
from loomlog.llm.packing import vocabulary


def aligned_plainly(rows: list[tuple]) -> list[tuple]:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of (doc_id, text), token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model, alphabet = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model")), byte_alphabet()
    counts: Counter = Counter()
    held = []
    for row_id, text in rows:
        whole = f" {text or ''}"
        a, b = a_model.encode(whole, add_special_tokens=False).ids, b_model.encode(text or "")
        a_bytes = [bytes(alphabet[c] for c in a_model.id_to_token(i)) for i in a]
        names = [b_model.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(n[3:5], 16)]) if b_model.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(b, names, strict=True)]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == whole.encode():
            held.append((row_id, None))
            continue
        ends = [[0], [0]]
        for side, parts in zip(ends, (a_bytes, b_bytes), strict=True):
            for x in parts:
                side.append(side[-1] + len(x))
        links, first = [], 0
        for i in range(len(a)):
            j = first
            while j < len(b) and ends[1][j] < ends[0][i + 1]:
                if ends[1][j + 1] > ends[0][i]:
                    links.append((a[i], b[j]))
                if ends[1][j + 1] <= ends[0][i + 1]:
                    first = j + 1
                j += 1
        both = set(ends[0][1:]) & set(ends[1][1:])
        sides = []
        for ids, at in zip((a, b), ends, strict=True):
            groups, group = [], []
            for i, e in zip(ids, at[1:], strict=True):
                group.append(str(i))
                if e in both:
                    groups.append(",".join(group))
                    group = []
            sides.append(groups)
        said = ";".join(f"{x}|{y}" for x, y in zip(*sides, strict=True))
        counts.update(links)
        held.append((row_id, (len(a), len(b), len(both), links, hashlib.sha256(said.encode()).hexdigest())))
    best: dict[int, int] = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(row_id, 0, 0, 0, 0, 0, 0, "") if x is None else (row_id, *x[:3], len(x[3]), sum(counts[k] == best[k[1]] for k in x[3]), sum(counts[k] for k in x[3]), x[4]) for row_id, x in held]
