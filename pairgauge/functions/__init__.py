"""Column functions: native expressions in ``text`` and ``numbers``, Arrow functions over XML in ``xml``."""
