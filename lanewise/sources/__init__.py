"""Readers, typed staging, option lists, report files and the derived sample tables."""
