"""Readers (S1-S7, U1-U2) and writers."""
