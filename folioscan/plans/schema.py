"""Tables of the library as schemas, with their keys and allowed values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import StructType

TABLES = {
    "users": "id string not null, email string not null, password_hash string not null, display_name string not null, role string not null, created_at timestamp not null",
    "course_spaces": "id string not null, name string not null, description string, owner_id string not null, created_at timestamp not null",
    "memberships": "id string not null, course_space_id string not null, user_id string not null, role string not null, created_at timestamp not null",
    "course_invites": "id string not null, course_space_id string not null, token string not null, email string, role string not null, created_by string not null, expires_at timestamp, revoked boolean not null, created_at timestamp not null",
    "documents": "id string not null, course_space_id string not null, filename string not null, content_type string not null, size_bytes bigint not null, sha256 string not null, storage_path string not null, page_count int, status string not null, error_message string, uploaded_by string not null, created_at timestamp not null, updated_at timestamp not null",
    "document_chunks": "id string not null, document_id string not null, chunk_index int not null, page_number int, content string not null, token_count int not null, created_at timestamp not null, embedding array<float>, content_terms array<string>",
    "chat_conversations": "id string not null, course_space_id string not null, created_by string not null, title string, created_at timestamp not null, updated_at timestamp not null",
    "chat_messages": "id string not null, conversation_id string not null, role string not null, content string not null, created_at timestamp not null",
}
UNIQUE = {"users": ["email"], "memberships": ["course_space_id", "user_id"], "course_invites": ["token"], "documents": ["course_space_id", "sha256"], "document_chunks": ["document_id", "chunk_index"]}
VALUES = {
    ("documents", "status"): ("UPLOADED", "EXTRACTING", "CHUNKING", "EMBEDDING", "READY", "FAILED"),
    ("memberships", "role"): ("OWNER", "INSTRUCTOR", "MEMBER"),
    ("users", "role"): ("USER", "ADMIN"),
    ("chat_messages", "role"): ("USER", "ASSISTANT"),
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def allowed(table: str, column: str) -> Column:
    return F.col(column).isin(*VALUES[table, column])


#: What an account, a question and a course may be: the rules of their fields. Fixed values.
def question_rules(question: Column) -> dict[str, list[tuple[Column, str]]]:
    return {"question": [(F.length(F.trim(question)) > 0, "must not be blank"), (F.length(question) <= 4000, "is too long")]}


def course_rules(name: Column, description: Column) -> dict[str, list[tuple[Column, str]]]:
    return {
        "name": [(F.length(F.trim(name)) > 0, "is required"), (F.length(name) <= 100, "is too long")],
        "description": [(F.length(F.coalesce(description, F.lit(""))) <= 1000, "is too long")],
    }


def register_rules(email: Column, password: Column, name: Column) -> dict[str, list[tuple[Column, str]]]:
    return {
        "email": [(F.length(F.trim(email)) > 0, "is required"), (F.regexp_like(email, F.lit(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")), "is no address")],
        "password": [(F.length(password).between(8, 72), "must have 8 to 72 characters")],
        "displayName": [(F.length(F.trim(name)) > 0, "is required"), (F.length(name) <= 100, "is too long")],
    }
