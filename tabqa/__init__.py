"""tabqa: table question-answering benchmarks built as Spark jobs.

Corpus generation, batched execution of typed query specs over many
tables, control filters, text rendering and scoring, all expressed with
the DataFrame API so Catalyst plans the work.
"""

__version__ = "0.1.0"
