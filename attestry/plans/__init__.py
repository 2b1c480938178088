"""Jobs: verdicts, rules, incidents, proofs, scorecard. Each reads tables and returns tables."""
