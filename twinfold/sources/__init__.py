"""Sources of file tables: directory trees and document corpora."""
