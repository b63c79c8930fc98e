"""Training-data operators that go with language-model corpora.

Nothing outside this subpackage imports it.
"""
