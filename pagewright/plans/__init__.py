"""Jobs composed of several operators: cutting, cleaning, judging and auditing whole corpora."""
