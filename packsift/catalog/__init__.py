"""Rule and reference tables. Everything here is data; the operators hold the logic."""
