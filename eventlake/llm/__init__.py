"""Training-data operators: packing, deduplication, decontamination, secret and
personal-data scans, WARC archives, a quality classifier and token counts.

Each module holds one operator with its own interface; ``catalog`` registers
the thin ``opN_<name>`` queries.  Nothing else in the library imports this.
"""
