"""Question plans: analyses over ledger inputs, their bindings to the test
tables and the SQL oracles used to check them."""
