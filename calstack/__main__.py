"""python -m calstack [WORD]: the vocabulary, or one word of it."""

import sys

from calstack.plans.vocabulary import vocabulary_rows, vocabulary_text

if len(sys.argv) > 1:
    print("\n".join(f"{name} {columns}: {doc} ({category})" for category, name, columns, doc in vocabulary_rows() if name in sys.argv[1:]))
else:
    print(vocabulary_text())
