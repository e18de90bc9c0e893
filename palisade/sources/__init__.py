"""Readers, writers and the derived views every operator family starts from."""
