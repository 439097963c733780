"""Relational operators over corpora, prefixes, suffixes, trees and groups."""
