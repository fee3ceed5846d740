"""Training-data operators over text, pages and chats. Nothing else in the library imports this subpackage."""
