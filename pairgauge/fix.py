"""Repair the spacing of one document: ``python -m pairgauge.fix [--simple] < in.xml > out.xml``, or with two file names.

Whole folders go through ``sources.transform_files``."""

from __future__ import annotations

import sys

from .functions import trees


def main(arguments: list[str]) -> int:
    change = trees.fix_simple if "--simple" in arguments else trees.fix_aligned
    names = [a for a in arguments if a != "--simple"]
    if len(names) not in (0, 2):
        print(__doc__, file=sys.stderr)
        return 2
    if names:
        with open(names[0], encoding="utf-8", newline="") as f:
            text = f.read()
        with open(names[1], "w", encoding="utf-8", newline="") as f:
            f.write(change(text) or "")
    else:
        text = sys.stdin.buffer.read().decode()
        sys.stdout.buffer.write((change(text) or "").encode())
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
