"""Relational operators over spans, lines, boxes, rows and scores."""
