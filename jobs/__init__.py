"""Jobs that can be run from the command line: python -m jobs.flux_ledger, python -m jobs.word_walks."""
