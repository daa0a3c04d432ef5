"""What a Python worker holds from one stage to the next."""

import subprocess
import sys

import numpy as np

from marlspan.llm import packing

HELD = """
import re
from marlspan.llm.common import let_go, remembered

def held():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

own, other = remembered("own"), remembered("other")
own["x"] = 1
before = held()
other.update((str(k), b"%d" % k) for k in range(500_000))
freed = [bytes(20_000) for _ in range(3000)]  # small enough to come from the C library's heap
last = bytes(20_000)
del freed
full = held()
let_go("own")
assert own and not other, (own, len(other))
assert held() - before < 0.3 * (full - before), (before, full, held())
"""


def test_a_stage_gives_back_what_others_held():
    subprocess.run([sys.executable, "-c", HELD], check=True)


def test_full_table_of_words_keeps_those_in_use():
    path = packing.vocabulary("word_bpe_49k.json")
    small, large = packing.WordEncoder(path, 60), packing.WordEncoder(path)
    often = "the cat sat on the mat. "
    texts = [often + " ".join(f"word{chr(97 + k % 26)}{chr(97 + j)}x" for j in range(20)) for k in range(26)]
    for t in texts:
        got, want = packing.flat_ids(small, [t, ""]), packing.flat_ids(large, [t, ""])
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
        assert len(small.known) <= 60 and "cat" in small.known
        assert small.encode([t]) == large.encode([t])
    learnt = []
    learn = small.learn
    small.learn = lambda fresh: learnt.extend(fresh) or learn(fresh)
    for t in texts:
        packing.flat_ids(small, [t])
    assert len(learnt) > 100 and "cat" not in learnt
