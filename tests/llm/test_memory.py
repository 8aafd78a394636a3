import subprocess
import sys

#: Blocks too small to be mapped on their own, freed below one that stays: the allocator keeps them all.
_TASK = """
import re
import sys
import numpy as np
sys.path.insert(0, sys.argv[1])
from ballast.llm import remember

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024

before = {}
remember.claim(before)
begin = held()
blocks = [np.ones(8_000) for _ in range(3_200)]  # some 200 MB
last = np.ones(8_000)
full = held()
del blocks
remember.claim(*[{}] * int(sys.argv[2]))
print(full - begin, held() - begin)
"""


def test_an_operator_that_takes_over_gives_back_what_the_one_before_has_freed():
    import ballast

    root = ballast.__path__[0].rsplit("/", 1)[0]
    for memories in ("0", "1"):
        full, left = map(int, subprocess.run([sys.executable, "-c", _TASK, root, memories], capture_output=True, text=True, check=True).stdout.split())
        assert full > 150 and left < 50
