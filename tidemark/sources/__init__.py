"""Payloads of other systems read as rows."""
